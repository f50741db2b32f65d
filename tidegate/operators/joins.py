"""Join and de-duplication helpers that hold up under skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, salts: int = 1) -> DataFrame:
    """Left join of many rows with one row per key.

    Nothing is measured or run while the plan is built: Spark broadcasts a side that turns out
    small and splits skewed keys.  With ``salts`` above 1 every key is spread over that many
    tasks, at the price of as many copies of the right side.
    """
    if salts <= 1:
        return left.join(right, key, "left")
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key.

    ``row_number() = 1`` is planned with a group limit before the exchange, so
    every map task sends one row per key however many copies it holds.
    """
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def log_order(df: DataFrame) -> list[Column]:
    """Topic, partition, offset, as far as the frame has them."""
    return [F.col(c) for c in ("topic", "partition", "offset") if c in df.columns]
