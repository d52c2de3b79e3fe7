"""Hierarchical regressions fitted by distributed aggregation, and their comparison."""
