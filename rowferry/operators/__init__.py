"""Operators over DataFrames: copies, results, access, audits, the dictionary."""
