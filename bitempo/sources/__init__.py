"""Readers of exported records, with fixed schemas."""
