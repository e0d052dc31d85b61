"""Operators on profiles, distances, trees and tests."""
