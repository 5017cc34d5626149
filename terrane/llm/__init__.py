"""Operators of a training-data pipeline over text, vectors and conversations.

Nothing else in the library imports this subpackage; it registers its queries through
:func:`terrane.llm.queries.queries`.
"""
