"""Operators for training-data pipelines; queries.py registers one query per operator."""
