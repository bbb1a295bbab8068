"""Operators for training-data pipelines: one module an operator, `queries` registers them."""
