"""Whole workflows built from the operators."""
