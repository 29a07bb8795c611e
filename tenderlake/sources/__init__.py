"""Reading snapshots and publishing tables."""
