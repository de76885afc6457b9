"""Structured Streaming into ledgers."""
