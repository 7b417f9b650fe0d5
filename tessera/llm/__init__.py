"""Operators for preparing language-model training text; nothing outside imports them."""
