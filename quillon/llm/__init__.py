"""Operators for preparing training text: deduplication, scans, packing and scoring."""
