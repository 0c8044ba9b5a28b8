"""Columns: predicates and time buckets."""
