"""Strict two-sided comparison of keyed tables, on Spark."""
