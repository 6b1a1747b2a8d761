"""Operators of a training-data pipeline: extraction, filters, near duplicates, mixing, tokens, archives and vector search."""
