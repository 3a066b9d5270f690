"""Operators for preparing training text: rules, scans, deduplication, tokens, packing."""
