"""Operators for large training-data pipelines over tables of documents."""
