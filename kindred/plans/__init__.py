"""Whole runs and the catalog of queries."""
