"""Operators of a training-data pipeline over text, vectors and media.

Nothing outside this folder imports it; `queries.py` registers one query per
operator and `__spark_entry__.py` adds them when this package is importable.
"""
