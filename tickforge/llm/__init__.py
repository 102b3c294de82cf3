"""Operators for preparing training data: filters, de-duplication, formatting, search, mixing."""
