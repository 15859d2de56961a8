"""Readers of records, snapshots, policies and versioned sources, and the sinks."""
