"""Operators that prepare training text: deduplication, filters, extraction, packing.

Nothing outside this package imports it; the queries it offers are in ``queries``.
"""
