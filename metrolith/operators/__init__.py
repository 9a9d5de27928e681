"""Analytic operators over frames."""
