"""Deterministic data-parallel operators on DataFrames, and operators for training-data pipelines."""
