"""Operators for preparing training data: documents, vectors and token sequences."""
