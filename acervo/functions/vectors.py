"""Vector arithmetic on two array columns of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions.text import col


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2sq(a: Column | str, b: Column | str) -> Column:
    return _sum(
        F.zip_with(col(a), col(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either norm is 0."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def similarity(distance: Column | str) -> Column:
    """Distance to a score in (0, 1], four places."""
    return F.round(1.0 / (1.0 + col(distance)), 4)
