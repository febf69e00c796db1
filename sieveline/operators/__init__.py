"""Predicates, aggregates, refinement, search, post-processing and validation."""
