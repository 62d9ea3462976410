"""Vector expressions over ``ARRAY<FLOAT>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    def square(x, y):
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda acc, x: acc + x)
