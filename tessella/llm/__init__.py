"""Operators for training-data pipelines over documents, pages and embeddings."""
