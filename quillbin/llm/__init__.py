"""Operators of a large-scale training-data pipeline, each a set of DataFrame plans."""
