"""Readers and writers of records and reports."""
