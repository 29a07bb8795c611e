"""Operators over any DataFrame: grouping, ranking, windows, merging, checking, profiling."""
