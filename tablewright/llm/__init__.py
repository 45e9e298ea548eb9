"""Operators for preparing training text: scoring, filters, de-duplication, tokens, packing."""
