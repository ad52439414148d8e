"""Operators for large training-data pipelines (deduplication, labelling, tokens, mixing)."""
