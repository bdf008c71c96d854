"""Operators that prepare training text: quality, URL and licence filters, deduplication, extraction, encoding, packing."""
