"""Operators for corpora of texts, pages and vectors; nothing else in the library imports them."""
