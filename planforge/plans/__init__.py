"""Queries as data, parsing, and running plans."""
