"""Operators of a training-data pipeline over documents, pages, conversations and embeddings.

Nothing outside this folder imports it.  Every module states what its operator does with nulls,
empty and very long texts, ties, repeated rows, empty tables and extra columns.
"""
