"""Staging, aggregates, dimensions, facts, marts and the queries that read them."""
