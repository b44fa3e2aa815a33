"""Readers and parsers that end in typed DataFrames."""
