"""Duplicate analytics and adaptive admission on Spark."""
