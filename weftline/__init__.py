"""Weftline: metadata integration as DataFrame transformations, and operators for training-data pipelines."""
