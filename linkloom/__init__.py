"""Saved-link analytics on Spark: capture, parsing, search, related links and Markdown vaults."""
