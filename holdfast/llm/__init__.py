"""Operators for preparing training text: fingerprints, archives, mixing, scans, de-duplication, tokens, search."""
