"""Operators for preparing training text: dedup, filters, tokens, chat formatting, personal data."""
