"""Operator 6: approximate nearest neighbours by collision-counting hashing.

Vectors are dealt into shards of ``SHARD_ROWS``. A shard is one row of the index, a table in the
shared folder: its vectors, and for each of ``PROJECTIONS`` random directions the sorted array of
their projections. A query opens a window around its own projection in every array. The windows
grow with the radius (virtual rehashing: nothing is hashed again, the windows' ends move outwards),
and each vector that enters a window counts a collision. Vectors that collide in enough arrays are
verified: their distance is computed exactly. A query ends in a shard once its ``k`` nearest lie
within the radius, or all vectors are verified. There is no cap on the verified ones.

All shards see all queries, which come in blocks of at most ``QUERY_BLOCK`` vectors; each shard
returns at most k rows for a query, and their nearest k are the answer.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part;
rows that share an id, or have none, are vectors of their own, and each row that is a query has ranks of its
own; vectors of another length than the query's are not its candidates; equal distances go to the smaller
id, a null id last; fewer than k candidates are all returned; empty tables give an empty result; other
columns are not read and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import Shared
from tidegate.plans.staging import staged

PROJECTIONS = 64
#: A vector at the radius falls into a window of this many radii with probability 0.68.
WINDOW = 2.0
#: Share of the arrays in which a vector must collide to be verified.
THRESHOLD = 0.55
#: Factor by which the radius grows.
GROWTH = 1.25
SHARD_ROWS = 20_000
QUERY_BLOCK = 20_000
SEED = 20_071


def usable(vector: Column) -> Column:
    """Whether a vector takes part: finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(table: DataFrame, key: str, vector: str) -> DataFrame:
    """``row`` (a mark of its own), ``id`` and ``v`` (doubles) of the rows that take part."""
    rows = table.select(table[key].cast("long").alias("id"), table[vector].cast("array<double>").alias("v"))
    return rows.where(usable(F.col("v"))).select(F.monotonically_increasing_id().alias("row"), "id", "v")


def directions(size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((PROJECTIONS, size))


def build_index(vectors: DataFrame) -> DataFrame:
    """One row for each shard: ``size``, ``rows``, ``ids``, ``data``, and the sorted arrays as ``order`` and ``values``.

    The rows of a shard are in the order of their ids, null last.
    """
    def shard(own: list[tuple[int, int | None]], data: list[np.ndarray], size: int) -> pa.RecordBatch:
        by_id = sorted(range(len(own)), key=lambda i: (own[i][1] is None, own[i][1] or 0))
        data = np.stack([data[i] for i in by_id])
        rows, ids = (np.array([own[i][j] or 0 for i in by_id], np.int64) for j in (0, 1))
        named = sum(i is not None for _, i in own)
        values = directions(size) @ data.T
        order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        blobs = (rows, ids, data, order, np.take_along_axis(values, order.astype(np.int64), 1))
        return pa.RecordBatch.from_arrays([pa.array([size]), pa.array([named]), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)],
                                          names=["size", "named", "rows", "ids", "data", "order", "values"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in rows:
            lists = batch.column(2)
            flat, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, own in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                size = int(bounds[i + 1] - bounds[i])
                owns, data = held.setdefault(size, ([], []))
                owns.append(own)
                data.append(flat[bounds[i] : bounds[i + 1]])
                if len(owns) >= SHARD_ROWS:
                    yield shard(*held.pop(size), size)
        for size, (owns, data) in held.items():
            yield shard(owns, data, size)

    return vectors.select("row", "id", "v").mapInArrow(run, "size long, named long, rows binary, ids binary, data binary, order binary, values binary")


class Shard:
    def __init__(self, size: int, named: int, rows: bytes, ids: bytes, data: bytes, order: bytes, values: bytes):
        self.rows, self.ids, self.named = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), named
        n = len(self.ids)
        self.data = np.frombuffer(data, np.float64).reshape(n, size)
        self.order = np.frombuffer(order, np.int32).reshape(PROJECTIONS, n)
        self.values = np.frombuffer(values, np.float64).reshape(PROJECTIONS, n)
        spread = np.sqrt(((self.data - self.data.mean(0)) ** 2).sum(1).mean())
        self.radius = max(float(spread) / 4, 1e-12)  # the first one; it shrinks to nothing for equal vectors

    def search(self, own: int, query: np.ndarray, lines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the shard and distances of the k nearest that are found; ``own``: the query's row, ``lines``: its projections."""
        n = len(self.ids)
        need = int(np.ceil(THRESHOLD * PROJECTIONS))
        hits = np.zeros(n, np.int32)
        left = np.array([np.searchsorted(v, x) for v, x in zip(self.values, lines)])
        right = left.copy()
        verified = self.rows == own
        found, distances, radius = np.zeros(0, np.int64), np.zeros(0), self.radius
        while True:
            half = WINDOW * radius / 2
            entered = []
            for i in range(PROJECTIONS):
                low = np.searchsorted(self.values[i, : left[i]], lines[i] - half)
                high = right[i] + np.searchsorted(self.values[i, right[i] :], lines[i] + half, side="right")
                entered += [self.order[i, low : left[i]], self.order[i, right[i] : high]]
                left[i], right[i] = low, high
            hits += np.bincount(np.concatenate(entered), minlength=n).astype(np.int32)
            fresh = np.flatnonzero((hits >= need) & ~verified)
            if len(fresh):
                verified[fresh] = True
                found = np.append(found, fresh)
                distances = np.append(distances, np.sqrt(((self.data[fresh] - query) ** 2).sum(1)))
                if len(found) > k:
                    best = np.lexsort((found, distances))[:k]  # places are in the order of ids
                    found, distances = found[best], distances[best]
            if verified.all() or (len(found) >= k and distances.max() <= radius):
                return found, distances
            radius *= GROWTH


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k nearest found for each query (``row``, ``id``, ``v``)."""
    spark = index.sparkSession

    def blocks() -> Iterator[list]:
        block = []
        for row in queries.toLocalIterator():
            block.append((row.row, row.id, row.v))
            if len(block) == QUERY_BLOCK:
                yield block
                block = []
        if block:
            yield block

    def one(block: list) -> DataFrame:
        shared = Shared(spark, block, _by_size)

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for row in batch.to_pylist():
                    owns, data = shared.get().get(row["size"], ([], None))
                    if not owns:
                        continue
                    shard, lines = Shard(**row), data @ directions(row["size"]).T
                    for i, (own, own_id) in enumerate(owns):
                        found, distance = shard.search(own, data[i], lines[i], k)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([own] * len(found), pa.int64()), pa.array([own_id] * len(found), pa.int64()),
                             pa.array(shard.ids[found], mask=found >= shard.named), pa.array(distance)], names=names)

        return index.mapInArrow(run, schema)

    schema, names = "query_row long, query_id long, vec_id long, score double", ["query_row", "query_id", "vec_id", "score"]
    none = spark.createDataFrame([], schema)
    found = reduce(DataFrame.unionByName, map(one, blocks()), none)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_size(block: list) -> dict[int, tuple[list[tuple], np.ndarray]]:
    """Rows with ids, and vectors, by length."""
    out: dict[int, tuple[list, list]] = {}
    for *own, vector in block:
        owns, data = out.setdefault(len(vector), ([], []))
        owns.append(tuple(own))
        data.append(vector)
    return {size: (owns, np.array(data, np.float64)) for size, (owns, data) in out.items()}


def nearest(table: DataFrame, is_query: Column, k: int = 10, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of each row of the table for whose ``id`` the condition holds."""
    vectors = staged(vectors_of(table, key, vector), "vectors")
    return search(staged(build_index(vectors), "projections"), vectors.where(is_query), k)
