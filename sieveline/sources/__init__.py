"""Readers and writers of tables, runs and results."""
