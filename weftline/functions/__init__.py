"""Column functions: text normalization, identifiers and array helpers."""
