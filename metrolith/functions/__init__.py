"""Scalar helpers: time, statistics, errors."""
