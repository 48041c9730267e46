"""Operators for large training-data pipelines over the tables documents, benchmark, embeddings, pages and labels.

Nothing else in the library imports this subpackage.
"""
