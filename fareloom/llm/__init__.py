"""Operators for preparing training corpora: deduplication, filtering, scoring, tokens, packing."""
