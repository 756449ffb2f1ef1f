"""Stores that grow by streams."""
