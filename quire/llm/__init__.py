"""Operators for preparing language-model training text.  Nothing outside this package imports it."""
