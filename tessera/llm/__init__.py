"""Operators of a training-data pipeline: one module each, their queries in ``queries``.

Operators that add columns to rows of any shape (``fresh``) take names that the rows do not have; those that
return ``_``-names add just these.
"""
