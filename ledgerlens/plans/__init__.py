"""Exact order statistics and running totals over distributed data."""
