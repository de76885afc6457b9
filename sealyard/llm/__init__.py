"""Operators for training-data pipelines: one module for each of the ten, and `queries` for their contracts."""
