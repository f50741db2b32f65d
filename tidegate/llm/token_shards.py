"""Operator 2: token ids as binary shards in training order.

Texts become token ids, closed by an end mark and cut into sequences of ``length`` tokens. The
sequences are numbered without gaps in the order of files and of rows in them (each split of a file is
counted, the counts of all splits give their first numbers), and a keyed Feistel network permutes the numbers: it is a bijection of a power of
four, and numbers that leave the range are sent through it again until they are back (cycle
walking), so every sequence gets one slot of 0 .. n - 1 and every slot one sequence. Slots are dealt
out by range. A shard holds ``SHARD`` consecutive slots, in blocks of records of one fixed stride,
in order; a reader finds any slot by division and goes on from there (``read_from``).

Order depends on the key and on the files' paths and rows alone: not on split sizes, cores or which task
read what. The numbered sequences are a written table, so a lost executor or a repeated task changes no
slot. ``docs`` should be a scan with filters and projections, one count a split; the order of rows that
were not read from files, or shuffled since, follows their partitions: write such a frame first.

Defined results: a null or empty text is one sequence of the end mark alone; repeated rows have
sequences of their own; an empty table has no shards; other columns are not read and may have any
names. Vocabularies of up to 65,536 ids are supported, the end mark included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from tidegate.llm.byte_bpe import read_ranks
from tidegate.llm.common import Shared, offsets, ragged, text_list
from tidegate.plans.staging import staged

LENGTH = 512
#: Slots of a shard, and of a block of it.
SHARD = 1 << 14
BLOCK = 1 << 10
ROUNDS = 6


class Permutation:
    """A keyed bijection of 0 .. n - 1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self._half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self._mask = np.uint64((1 << int(self._half)) - 1)
        self._keys = np.random.default_rng(key).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) & self._mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self._half, x & self._mask
        for key in self._keys[::-1] if back else self._keys:
            if back:
                left, right = right ^ self._mixed(left, key), left
            else:
                left, right = right, left ^ self._mixed(right, key)
        return left << self._half | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        while (away := out >= self.n).any():
            out[away] = self._once(out[away], back)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def _tokenizer(spec: tuple[dict[bytes, int], str]) -> tiktoken.Encoding:
    ranks, pattern = spec
    return tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_places(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``text``, and where a row was read: ``file`` and the ``start`` of its split; no file if it was not read from one."""
    columns = [docs[key].alias("key"), docs[text].alias("text")]
    try:
        read = docs.metadataColumn("_metadata")
        return docs.select(*columns, read["file_path"].alias("file"), read["file_block_start"].alias("start"))
    except AnalysisException:
        return docs.select(*columns, F.lit("").alias("file"), F.lit(0).cast("long").alias("start"))


def number_sequences(docs: DataFrame, ranks_path: str, pattern: str, end: int, length: int, *, key: str,
                     text: str) -> DataFrame:
    """``key``, ``ids`` (16-bit), and the sequences' place: ``file``, ``start`` and ``task``, and ``first`` of the ``n`` of a
    text in that place. One scan."""
    shared = Shared(docs.sparkSession, (read_ranks(ranks_path), pattern), _tokenizer)
    rows = with_places(docs, key, text)
    schema = (rows.select("key").schema.add("ids", "binary").add("file", "string").add("start", "long").add("task", "integer")
              .add("first", "long").add("n", "long"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, used = shared.get().encode_ordinary, TaskContext.get().partitionId(), {}
        for batch in rows:
            ids = [np.array([*encode(t), end], np.uint16) for t in text_list(batch.column(1))]
            n = [-(-len(i) // length) for i in ids]
            first = []
            for place, size in zip(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()), n):
                first.append(used.get(place, 0))
                used[place] = first[-1] + size
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([i.astype("<u2").tobytes() for i in ids], pa.binary()), batch.column(2), batch.column(3),
                 pa.array(np.full(len(n), task, np.int32)), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def shards(docs: DataFrame, ranks_path: str, pattern: str, *, end: int, seed: int, length: int = LENGTH,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each block, in order: ``shard``, ``first_slot``, ``n``, ``stride``, ``payload`` of n records of
    that many bytes, and for each record its ``keys``, ``parts`` (the place in its text) and ``lengths`` (in tokens).
    """
    spark = docs.sparkSession
    numbered = staged(number_sequences(docs, ranks_path, pattern, end, length, key=key, text=text), "sequences", "zstd")
    counts = sorted(map(tuple, numbered.groupBy("file", "start", "task").agg(F.sum("n")).collect()))  # a row for each split
    total = sum(n for *_, n in counts)
    starts = dict(zip((tuple(place) for *place, _ in counts), offsets(np.array([n for *_, n in counts], np.int64)).tolist()))
    shared = Shared(spark, (starts, total, seed), lambda p: (p[0], Permutation(p[1], p[2])))
    stride = 2 * length
    placed_schema = numbered.select(F.lit(0).cast("long").alias("slot"), "key").schema.add("part", "long").add("record", "binary")

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_of, order = shared.get()
        for batch in rows:
            first, n = (batch.column(i).to_numpy() for i in (5, 6))
            places = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
            number = np.array([first_of[place] for place in places], np.int64) + first
            which, part = np.repeat(np.arange(len(n)), n), ragged(np.zeros(len(n), np.int64), n)
            ids = batch.column(1).to_pylist()
            records = [ids[i][p * stride : (p + 1) * stride] for i, p in zip(which.tolist(), part.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(order.slot(number[which] + part)), batch.column(0).take(pa.array(which)), pa.array(part),
                 pa.array(records, pa.binary())], names=placed_schema.names)

    placed = numbered.mapInArrow(place, placed_schema).withColumn("block", F.expr(f"slot div {BLOCK}"))
    ranges = max(1, -(-total // SHARD))
    # ranges of whole blocks: a shard has many, so the sampled bounds deal them out evenly
    ordered = placed.repartitionByRange(ranges, "block").sortWithinPartitions("slot")
    key_type = placed_schema["key"].dataType
    schema = (spark.createDataFrame([], "shard long, first_slot long, n long, stride long, payload binary").schema
              .add("keys", ArrayType(key_type)).add("parts", ArrayType(LongType())).add("lengths", ArrayType(LongType())))

    def block(table: pa.Table) -> pa.RecordBatch:
        slot, records = int(table.column("slot")[0].as_py()), table.column("record").to_pylist()
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays(
            [pa.array([slot // SHARD]), pa.array([slot]), pa.array([len(records)]), pa.array([stride]),
             pa.array([b"".join(r.ljust(stride, b"\0") for r in records)], pa.binary()), one(table.column("key").combine_chunks()),
             one(table.column("part").combine_chunks()), one(pa.array([len(r) // 2 for r in records], pa.int64()))],
            names=schema.names)

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in rows:
            slots = batch.column(0).to_numpy()
            cuts = np.flatnonzero(slots % BLOCK == BLOCK - 1) + 1
            low = 0
            for cut in cuts.tolist():
                yield block(pa.Table.from_batches([*held, batch.slice(low, cut - low)]))
                held, low = [], cut
            if low < batch.num_rows:
                held.append(batch.slice(low))
        if held:
            yield block(pa.Table.from_batches(held))

    return ordered.select("slot", "key", "part", "record").mapInArrow(write, schema)


def read_from(blocks: DataFrame, slot: int = 0, n: int | None = None) -> DataFrame:
    """The sequences from a slot on: ``slot``, ``key``, ``part`` and ``ids``. Only the blocks asked for are read."""
    last = F.col("first_slot") + F.col("n") - 1
    wanted = blocks.where(last >= slot) if n is None else blocks.where((last >= slot) & (F.col("first_slot") < slot + n))
    schema = (blocks.select(F.lit(0).cast("long").alias("slot"), F.col("keys")[0].alias("key")).schema
              .add("part", "long").add("ids", ArrayType(IntegerType())))
    end = None if n is None else slot + n

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                first, stride, payload = (batch.column(j)[i].as_py() for j in (1, 3, 4))
                keys, parts, sizes = (batch.column(j)[i].values for j in (5, 6, 7))
                low, high = max(slot - first, 0), len(keys) if end is None else min(end - first, len(keys))
                size = sizes.to_numpy()[low:high]
                tokens = np.frombuffer(payload, "<u2").astype(np.int32)
                at = np.arange(low, high) * (stride // 2)
                ids = pa.ListArray.from_arrays(pa.array(offsets(size), pa.int32()), pa.array(tokens[ragged(at, size)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + low, first + high)), keys.slice(low, high - low),
                                                  parts.slice(low, high - low), ids], names=schema.names)

    return wanted.mapInArrow(run, schema)
