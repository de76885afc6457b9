"""Operators over ledger records, blocks, collections and logs: each takes and returns DataFrames."""
