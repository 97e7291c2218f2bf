"""Readers of dictionary and book archives, and writers."""
