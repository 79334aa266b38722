"""Operators for preparing training text: deduplication, search, mixing, archives, tokens and scans.

Nothing outside this subpackage imports it.
"""
