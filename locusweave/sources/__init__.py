"""Readers that turn delivered files and raw tables into the canonical tables."""
