"""Operators over tables of entities."""
