"""Operators for large-scale training-data preparation.

Each operator is a module with its own general interface; the registered
queries (``tessera.llm.queries``) derive digests from the operators' real
outputs.  Nothing outside this package imports it.
"""
