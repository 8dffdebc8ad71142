"""Expressions on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_array(values) -> Column:
    """A constant ``array<double>``."""
    return F.array(*[F.lit(float(v)) for v in values])


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of one length."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def norm_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of one length."""
    return F.sqrt(squared_distance(a, b))
