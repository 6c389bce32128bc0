"""Operators for large-scale training-data pipelines.

Each module holds one operator with its own general interface; the thin
contract queries over the standard tables are in ``queries.py``.
"""
