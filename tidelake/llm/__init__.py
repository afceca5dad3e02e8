"""Operators of a training-data pipeline: dedup, filtering, scoring, mixing, packing, search and archive records.

Nothing outside this subpackage imports it.
"""
