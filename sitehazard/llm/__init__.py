"""Operators for preparing training data: filters, duplicates, scans, tokens, archives."""
