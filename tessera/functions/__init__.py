"""Scalar functions on text."""
