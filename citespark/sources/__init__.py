"""Readers and writers for raw tables, vector files and run results."""
