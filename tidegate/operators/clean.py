"""Loading of upstream rows: map columns, skip what is known, assign ids."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.text import collapse_blanks, stable_quantity, weight_to_kg
from tidegate.plans.staging import staged

TRANSFORMS = {"stable_quantity": stable_quantity, "weight_to_kg": weight_to_kg}


def mapped_column(df: DataFrame, spec: dict[str, Any]) -> Column:
    """First non-empty source column, transformed, blanks collapsed, cut to length."""
    names = spec["from"] if isinstance(spec["from"], list) else [spec["from"]]
    have = [F.col(f"`{n}`") for n in names if n in df.columns]
    value = F.coalesce(*[F.when(c.cast("string") != "", c) for c in have]) if have else F.lit(None).cast("string")
    if spec.get("transform"):
        return TRANSFORMS[spec["transform"]](value)
    texts = all(isinstance(df.schema[n].dataType, T.StringType) for n in names if n in df.columns)
    return collapse_blanks(value, spec.get("max_length")) if texts else value


def map_columns(df: DataFrame, columns: dict[str, dict[str, Any]], keep: list[str] | None = None) -> DataFrame:
    """Target columns by specification (``from``, ``transform``, ``max_length``)."""
    return df.select(*(keep or []), *[mapped_column(df, spec).alias(n) for n, spec in columns.items()])


def load_new(incoming: DataFrame, parent: DataFrame, child_columns: list[str], existing_child: DataFrame,
             child_key: str, order: str, id_column: str = "id", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """New parent and child rows: named, not known yet, each name once, with fresh ids.

    Child columns that the child table does not have are left out.  Ids follow
    the order of ``order``: positions within a range partition plus the sizes of
    the partitions before it, so no single task sees all rows.
    """
    named = incoming.filter(F.coalesce(F.col(name), F.lit("")) != "")
    first = Window.partitionBy(name).orderBy(order)
    fresh = named.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").join(
        parent.select(name).distinct(), name, "left_anti")
    numbered = number_rows(fresh, order)
    start = parent.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("bigint").alias("_start"))
    placed = numbered.withColumn("_one", F.lit(1)).join(
        F.broadcast(start.withColumn("_one", F.lit(1))), "_one").withColumn(
            id_column, F.col("_start") + F.col("_position")).drop("_one", "_start", "_position")
    kept = [c for c in child_columns if c in existing_child.columns and c in placed.columns]
    parents = placed.select(id_column, *[c for c in parent.columns if c != id_column and c in placed.columns])
    return parents, placed.select(F.col(id_column).alias(child_key), *kept)


def number_rows(df: DataFrame, order: str) -> DataFrame:
    """``_position`` 1..n by ``order`` (any type that sorts, unique) without one global window.

    The rows are written once in ranges of ``order``, with their range and place in it; both come
    from that table, so a repeated task cannot number them otherwise.  A position is the place
    plus the sizes of the ranges before, of which there are as many as partitions.
    """
    place = F.monotonically_increasing_id()  # the partition in the upper bits, the row in the lower 33
    ranges = staged(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_place", place), "ranges")
    ranges = ranges.withColumn("_range", F.shiftright("_place", 33))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(
        Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranges.join(F.broadcast(before.select("_range", "_before")), "_range").withColumn(
        "_position", F.col("_before") + local).drop("_range", "_before", "_place")
