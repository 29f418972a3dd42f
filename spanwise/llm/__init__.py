"""Operators for preparing training text: tokens, languages, duplicates, quality, mixing and search."""
