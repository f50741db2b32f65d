"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Inside a lambda Catalyst does not share common sub-expressions, so a value
    used several times would be computed several times.
    """
    return F.transform(F.array(value), body)[0]


def fence(value: Column) -> Column:
    """``value`` as a column that filters above it are not pushed through.

    A filter on a derived column is normally pushed below the projection, which
    repeats the whole derivation in the filter.  A generator output is not, so
    the derivation runs once per row.  Use it once in a select.
    """
    return F.explode(F.array(value))


def seal(df: DataFrame, names: list[str]) -> DataFrame:
    """Put derived columns behind a fence, so that later filters do not repeat them."""
    rest = [c for c in df.columns if c not in names]
    packed = df.withColumn("_packed", F.struct(*names))
    return packed.select(*rest, fence(F.col("_packed")).alias("_sealed")).select(*rest, "_sealed.*")


def non_null(array: Column) -> Column:
    return F.filter(array, lambda x: x.isNotNull())


def join_text(array: Column, separator: str) -> Column:
    return F.array_join(array, separator)
