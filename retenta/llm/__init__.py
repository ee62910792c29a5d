"""Operators for text corpora, each usable alone; nothing else in the library imports them."""
