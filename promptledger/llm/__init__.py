"""Operators for large text corpora: tokenising, deduplication, quality, safety, chat formatting."""
