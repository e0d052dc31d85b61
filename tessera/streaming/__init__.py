"""Incremental forms for streams."""
