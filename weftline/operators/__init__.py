"""DataFrame operators: validation, resolution, entity grouping, comparison and ownership merge."""
