"""Operators that prepare training text: tokens, mixtures, duplicates, archives, filters."""
