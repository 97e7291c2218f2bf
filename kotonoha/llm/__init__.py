"""Operators for building training corpora.

Nothing else in the library imports this subpackage; its queries are registered by
``kotonoha.llm.queries``.
"""
