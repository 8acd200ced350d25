"""Operators for large-scale training-data pipelines, each over whole tables."""
