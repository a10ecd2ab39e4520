"""Operators for training data: search, labels, scans, near duplicates, formatting, archives and packing."""
