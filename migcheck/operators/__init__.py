"""Operators over DataFrames: profiles, checksums, key checks, comparisons, schemas, mappings."""
