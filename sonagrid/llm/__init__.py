"""Operators of a large-scale training-data pipeline over a ``documents`` table."""
