"""Operators for preparing training text: one module per operator.

Nothing else in the package imports this subpackage. Each module states its
method, its parameters and what it returns for nulls, empty or very long
texts, ties, repeated rows, empty tables and extra columns. ``queries``
registers one query per operator over the ``documents``, ``embeddings`` and
``pages`` tables.
"""
