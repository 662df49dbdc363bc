"""Operators for training-data pipelines over texts and item lists. Nothing outside imports this package."""
