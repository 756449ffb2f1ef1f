"""Operators over stores of evidence units."""
