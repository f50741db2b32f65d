"""Connected components of links, by shuffles only: no link or component reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.plans.staging import drop_shared, write_shared


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node that has a link to another.

    Alternates two steps until nothing changes: each node hands the smallest of its neighbours and
    itself to its larger neighbours, then to its smaller ones. Both only need minima, which are
    combined before the shuffle, and joins on the node, whose skewed keys Spark splits. Every round
    is a written table, so a lost executor costs no more than its own tasks.
    """
    spark = links.sparkSession
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    path, state = _written(pairs)
    while True:
        now = spark.read.parquet(path)
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        middle = write_shared(large, "links")
        large = spark.read.parquet(middle)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        following, new_state = _written(small)
        drop_shared(spark, middle)
        drop_shared(spark, path)
        path = following
        if new_state == state:
            break
        state = new_state
    stars = spark.read.parquet(path)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _written(pairs: DataFrame) -> tuple[str, tuple]:
    """The pairs as a table, and a digest by which two rounds are told apart."""
    path = write_shared(pairs, "links")
    digest = F.xxhash64("u", "v").cast("decimal(20,0)")
    return path, tuple(pairs.sparkSession.read.parquet(path).agg(F.count("*"), F.sum(digest)).first())
