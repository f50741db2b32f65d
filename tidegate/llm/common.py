"""Settings and small helpers that the operators of this package share."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidegate.session import configure

#: Rows and bytes of one Arrow batch between Spark and a Python worker. Texts are of any length,
#: so the default of 10,000 rows would not bound a worker's memory.
_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings of the library and those of this package to a session."""
    configure(spark)
    for name, value in _SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


class Shared:
    """A small object of proven size that every task needs, sent once to each executor.

    ``make`` turns the sent payload into what tasks use, once in each worker process. A process keeps
    what was made last, and nothing of earlier stages.
    """

    def __init__(self, spark: SparkSession, payload: object, make: Callable[[object], object]):
        self._sent = spark.sparkContext.broadcast(pickle.dumps(payload, protocol=5))
        self._name = uuid.uuid4().hex
        self._make = make

    def get(self):
        if self._name not in _MADE:
            _MADE.clear()
            _MADE[self._name] = self._make(pickle.loads(self._sent.value))
        return _MADE[self._name]


_MADE: dict[str, object] = {}


def text_list(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The texts of a column; null reads as empty."""
    return [t or "" for t in column.to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Running sums of lengths, from 0 to the total."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def batches_of(rows: Iterator[pa.RecordBatch], full: Callable[[int, int], bool], column: str) -> Iterator[pa.Table]:
    """Join small batches until ``full(rows, bytes of column)`` holds."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for batch in rows:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        n += batch.num_rows
        size += batch.column(column).nbytes
        if full(n, size):
            yield pa.Table.from_batches(held)
            held, n, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)
