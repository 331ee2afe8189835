"""Operators: skew-safe joins, ranking and paging, loading, merging, checking."""
