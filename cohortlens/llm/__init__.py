"""Operators for large-scale training-data pipelines, and the queries that apply them."""
