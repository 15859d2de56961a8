"""Incremental upkeep of snapshots and decisions."""
