"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing outside this subpackage imports it.
"""
