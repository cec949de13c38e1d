"""Operators of a training-data pipeline (tokenisation, filtering, deduplication).

Nothing else in the library imports this subpackage. The operators are
DataFrame functions; :mod:`entailer.llm.queries` holds the registered queries.
"""
