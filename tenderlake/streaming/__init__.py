"""Incremental work on newly arrived snapshots."""
