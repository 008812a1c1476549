"""Operators for large training-data pipelines, and the queries that apply them to whole tables."""
