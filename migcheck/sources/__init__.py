"""Readers and writers that return or take lazy DataFrames."""
