"""Operators for training-data pipelines over documents, pages, benchmarks and labels."""
