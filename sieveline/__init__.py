"""Subgroup discovery and exceptional model mining as DataFrame pipelines."""
