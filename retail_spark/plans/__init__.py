"""Whole pipelines, analyses and reports built from the operators."""
