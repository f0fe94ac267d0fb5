"""Readers of variant files, traits and gene tables, and writers of results."""
