"""Operators for preparing text corpora: sharding, mixing, deduplication, token counts and the like."""
