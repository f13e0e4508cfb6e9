"""Algebra on ``array<float>`` columns in double precision, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a side is null or all zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def usable(a: Column | str) -> Column:
    """Neither null nor empty nor all zero, and every component finite."""
    return F.coalesce(norm(a) > 0, F.lit(False)) & ~F.coalesce(F.isnan(norm(a)), F.lit(True)) & (norm(a) < float("inf"))


def unit(a: Column | str) -> Column:
    """Length one; null where that is impossible."""
    n = F.nullif(norm(a), F.lit(0.0))
    return F.transform(_c(a), lambda x: x.cast("double") / n)
