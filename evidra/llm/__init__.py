"""Operators for preparing training text: sharding, token files, filters, near-duplicates, packing.

The subpackage stands alone: nothing else in the library imports it, and it
imports nothing from the rest.
"""
