"""Relational building blocks: scoring, ranking, filters, writes and set comparisons."""
