"""Operators of a training-data pipeline on text and embeddings.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` registers one query per
operator over the whole of its table.
"""
