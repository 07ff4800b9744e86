"""Operators over dense indexes and blocks: maps, reductions, scans, bulk queries, kernels."""
