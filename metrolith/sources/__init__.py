"""Readers and inspection of sources."""
