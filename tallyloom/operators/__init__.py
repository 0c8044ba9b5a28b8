"""Operators on DataFrames: metrics, result shaping, segments, funnels, dictionaries."""
