"""Operators for preparing training data: filters, duplicate detection, packing, tokenising."""
