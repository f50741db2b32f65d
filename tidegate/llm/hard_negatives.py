"""Operator 11: hard negatives from Hilbert-ordered blocks with zone maps.

Vectors become integers (``floor(scale * x)``) and are laid out as a table of blocks: ordered by length, label
and their place on a Hilbert curve through a few projections, cut into blocks of some hundred rows. A block
carries a zone map, the least and largest value of each dimension and the range of its labels. A score is an
inner product; interval arithmetic on the zone map bounds the scores of an anchor with all rows of a block.

1. Anchors take a first bound from their own block: the score of the k-th best row of their label there.
2. Blocks that may hold a better row of their label are read; the best k are the positives.
3. Each positive opens a window of scores. Blocks whose bounds meet a window, and that hold other labels, are
   read; the best rows of other labels inside are the negatives.

Anchors travel in packs, zone maps in pages; a pack meets all pages (the stated query set against all
blocks), and only the anchors that need a block are sent to it, so block data is joined by block number
and no task holds more than a pack and a block at a time. Tasks keep the best rows of each anchor only.
Nothing passes through the driver but the number of pages.

Scores are exact: in doubles or 64-bit integers where their bound allows it, else in integers of any length
(results beyond 64 bits stay at the largest or smallest one).

Defined results: rows with a null label, a null vector, a null or non-finite component (also after scaling)
take no part; vectors of another length are not compared; a row with a null key is never an anchor and comes
last among equals; rows that share a key are rows of their own; ties go to the smaller key; fewer rows than asked for are all returned;
an empty table gives an empty result; other columns are not read and may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.plans.staging import staged

#: Rows of a block, less for long vectors; anchors of a pack; zone maps of a page.
BLOCK_ROWS = 1024
BLOCK_BYTES = 1 << 20
PACK = 256
PAGE = 256
#: Parts over which pages are dealt out at most; every pack is sent to each.
PARTS = 256
#: Projections and bits of each on the curve; one more coordinate is the vector's length.
DIRECTIONS = 9
BITS = 6
SEED = 9_176
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_TYPES = {2: np.int16, 4: np.int32, 8: np.float64}


# -- layout --------------------------------------------------------------------------------------

def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with non-negative integer coordinates below 2 ** bits (Skilling's method)."""
    x = points.T.astype(np.int64)
    for b in range(bits - 1, 0, -1):
        bit, below = 1 << b, (1 << b) - 1
        for axis in range(len(x)):
            up = (x[axis] & bit) > 0
            x[0] ^= np.where(up, below, 0)
            swap = np.where(up, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= swap
            x[axis] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            out = out << 1 | (x[axis] >> b & 1)
    return out


def curve_place(vectors: np.ndarray) -> np.ndarray:
    """Where vectors of one length stand on the curve: by direction, and by the logarithm of their norm."""
    n, size = vectors.shape
    norm = np.sqrt(np.square(vectors / 2.0**20).sum(1)) * 2.0**20
    lines = np.random.default_rng([SEED, size]).standard_normal((size, DIRECTIONS))
    along = (vectors / np.maximum(norm, 1e-300)[:, None]) @ lines
    top = (1 << BITS) - 1
    coordinates = np.column_stack([(along + 3) / 6 * top, 2 * np.log2(np.maximum(norm, 1.0))])
    return hilbert(np.clip(np.rint(coordinates), 0, top).astype(np.int64), BITS)


def place_rows(table: DataFrame, is_anchor: Column, *, key: str, label: str, vector: str, scale: float) -> DataFrame:
    """``row``, ``id``, ``label``, ``anchor``, ``size``, ``width``, ``place`` and ``v`` of the rows that take part."""
    rows = table.select(table[key].cast("long").alias("id"), table[label].cast("long").alias("label"),
                        F.coalesce(is_anchor & table[key].isNotNull(), F.lit(False)).alias("anchor"), table[vector].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    schema = "row long, id long, label long, anchor boolean, size int, width int, place long, v binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = batch.column(4).values.to_numpy(), batch.column(4).offsets.to_numpy()
            sizes = np.diff(bounds)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                with np.errstate(over="ignore"):
                    values = np.floor(scale * flat[bounds[at][:, None] + np.arange(size)])
                whole = np.isfinite(values).all(1)
                at, values = at[whole], values[whole]
                most = np.abs(values).max(axis=1, initial=0)
                width = np.where(most < 2**15, 2, np.where(most < 2**31, 4, 8))
                data = [v.astype(_TYPES[w]).tobytes() for v, w in zip(values, width.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*batch.select([0, 1, 2, 3]).take(pa.array(at)).columns, pa.array(np.full(len(at), size, np.int32)),
                     pa.array(width.astype(np.int32)), pa.array(curve_place(values) if size else np.zeros(len(at), np.int64)),
                     pa.array(data, pa.binary())], names=["row", "id", "label", "anchor", "size", "width", "place", "v"])

    usable = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    return usable.select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", "v").mapInArrow(run, schema)


_BLOCK = ("block long, size int, width int, low_label long, high_label long, low binary, high binary, "
          "labels binary, ids binary, no_id binary, rows binary, anchors binary, data binary")


def build_blocks(placed: DataFrame) -> DataFrame:
    """The blocks, in the order of length, label and place."""
    order = ["size", "width", "label", "place", "row"]

    def block(number: int, rows: list[tuple], size: int, width: int) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[4] for r in rows), _TYPES[width]).reshape(len(rows), size)
        labels = np.array([r[2] for r in rows], np.int64)
        ids = np.array([0 if r[1] is None else r[1] for r in rows], np.int64)
        blobs = [data.min(0).astype(np.float64), data.max(0).astype(np.float64), labels, ids,
                 np.array([r[1] is None for r in rows], np.uint8), np.array([r[0] for r in rows], np.int64),
                 np.array([r[3] for r in rows], np.uint8), data]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([size], pa.int32()), pa.array([width], pa.int32()), pa.array([labels.min()]), pa.array([labels.max()]),
             *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names=[f.split()[0] for f in _BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        kind = last = None
        for batch in batches:
            for size, width, label, row, key, anchor, v in zip(*(c.to_pylist() for c in batch.columns)):
                full = max(16, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(size, 1))))
                if held and (kind != (size, width) or len(held) >= full or label != last and len(held) >= full // 4):
                    yield block(number, held, *kind)
                    held, number = [], number + 1
                kind, last = (size, width), label
                held.append((row, key, label, anchor, v))
        if held:
            yield block(number, held, *kind)

    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("size", "width", "label", "row", "id", "anchor", "v").mapInArrow(run, _BLOCK)


class Block:
    """A row of the block table as arrays."""

    def __init__(self, row: dict):
        self.block, self.size = row["block"], row["size"]
        self.labels, self.ids, self.rows = (np.frombuffer(row[c], np.int64) for c in ("labels", "ids", "rows"))
        self.no_id = np.frombuffer(row["no_id"], np.uint8)
        self.data = np.frombuffer(row["data"], _TYPES[row["width"]]).reshape(len(self.rows), self.size)


# -- scores --------------------------------------------------------------------------------------

def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integral rows, as 64-bit integers."""
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    long = [[int(x) for x in row] for row in b.tolist()]
    out = [[min(max(sum(int(x) * y for x, y in zip(own, other)), _LOW), _HIGH) for other in long] for own in a.tolist()]
    return np.array(out, np.int64).reshape(len(a), len(b))


def score_bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible scores of vectors with the rows of blocks, by interval arithmetic; never too narrow."""
    up, down = np.maximum(a, 0.0), np.minimum(a, 0.0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    size = np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T
    slack = np.where(size < 2**52, 0.0, size * 1e-9)
    return least - slack, most + slack


def _best_of(scores: np.ndarray, at: np.ndarray, block: Block, k: int) -> np.ndarray:
    """The k best of the rows ``at``: higher scores first, then smaller keys."""
    if len(at) > k:
        own = scores[at]
        at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return at[np.lexsort((block.rows[at], block.ids[at], block.no_id[at], -scores[at]))[:k]]


# -- anchors -------------------------------------------------------------------------------------

_ANCHOR = "a long, anchor_id long, label long, size int, width int, v binary, place long, bound long"


def find_anchors(blocks: DataFrame, k: int) -> DataFrame:
    """Every anchor, with the score of the k-th best row of its label in its own block as a bound."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                own = np.flatnonzero(np.frombuffer(row["anchors"], np.uint8))
                if not len(own):
                    continue
                bounds = []
                for i, scores in zip(own.tolist(), exact_scores(block.data[own], block.data)):
                    scores = scores[(block.labels == block.labels[i]) & (block.rows != block.rows[i])]
                    bounds.append(int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else _LOW)
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.rows[own]), pa.array(block.ids[own]), pa.array(block.labels[own]),
                     pa.array(np.full(n, row["size"], np.int32)), pa.array(np.full(n, row["width"], np.int32)),
                     pa.array([block.data[i].tobytes() for i in own.tolist()], pa.binary()),
                     pa.array(np.full(n, row["block"])), pa.array(bounds, pa.int64())],
                    names=[f.split()[0] for f in _ANCHOR.split(", ")])

    return blocks.mapInArrow(run, _ANCHOR)


def _packs(anchors: DataFrame, limits: str) -> DataFrame:
    """Anchors of one length, neighbours on the curve together; ``limits`` is a column of long arrays of one length."""
    def pack(size: int, rows: list[tuple]) -> pa.RecordBatch:
        vectors = np.stack([np.frombuffer(v, _TYPES[w]).astype(np.float64) for _, _, w, v, _ in rows])
        blobs = [np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), vectors,
                 np.array([r[4] for r in rows], np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)],
                                          names=["size", "a", "own", "vectors", "limits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for size, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                own = held.setdefault(size, [])
                own.append(tuple(rest))
                if len(own) == PACK:
                    yield pack(size, held.pop(size))
        for size, own in held.items():
            yield pack(size, own)

    ordered = anchors.repartitionByRange("size", "place", "a").sortWithinPartitions("size", "place", "a")
    return ordered.select("size", "a", "label", "width", "v", limits).mapInArrow(
        run, "size int, a binary, own binary, vectors binary, limits binary")


def build_pages(blocks: DataFrame) -> DataFrame:
    """Zone maps, up to ``PAGE`` in a row. Block data is not read."""
    names = ["block", "low_label", "high_label"]

    def page(size: int, rows: list[tuple]) -> pa.RecordBatch:
        blobs = [np.array([r[i] for r in rows], np.int64).tobytes() for i in range(3)] + [b"".join(r[i] for r in rows) for i in (3, 4)]
        return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)],
                                          names=["size", *names, "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for size, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                own = held.setdefault(size, [])
                own.append(tuple(rest))
                if len(own) == PAGE:
                    yield page(size, held.pop(size))
        for size, own in held.items():
            yield page(size, own)

    return blocks.select("size", *names, "low", "high").mapInArrow(
        run, "size int, block binary, low_label binary, high_label binary, low binary, high binary")


#: Which anchors (rows) need which blocks (columns): from least and largest scores, anchors' labels and limits, label ranges.
Rule = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def same_label_above(least, most, own, limits, low_label, high_label):
    return (low_label <= own[:, None]) & (own[:, None] <= high_label) & (most >= limits[:, :1])


def other_label_within(least, most, own, limits, low_label, high_label):
    others = ~((low_label == own[:, None]) & (high_label == own[:, None]))
    met = np.zeros(most.shape, bool)
    for i in range(0, limits.shape[1], 3):
        met |= (most >= limits[:, i + 1, None]) & (least <= limits[:, i + 2, None]) & (limits[:, i + 1, None] <= limits[:, i + 2, None])
    return others & met


_NEED = "block long, a binary, own binary, vectors binary, limits binary"


def needed_blocks(anchors: DataFrame, limits: str, pages: DataFrame, rule: Rule) -> DataFrame:
    """For each block and pack the anchors that must read the block. ``pages`` is a stored table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, own, blocks, low_label, high_label = (np.frombuffer(r[c], np.int64) for c in ("a", "own", "block", "low_label", "high_label"))
                vectors = np.frombuffer(r["vectors"], np.float64).reshape(len(a), r["size"])
                limits_ = np.frombuffer(r["limits"], np.int64).reshape(len(a), -1)
                low, high = (np.frombuffer(r[c], np.float64).reshape(len(blocks), r["size"]) for c in ("low", "high"))
                need = rule(*score_bounds(vectors, low, high), own, limits_, low_label, high_label)
                for j in np.flatnonzero(need.any(0)).tolist():
                    at = np.flatnonzero(need[:, j])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([blocks[j]]), *(pa.array([x[at].tobytes()], pa.binary()) for x in (a, own, vectors, limits_))],
                        names=["block", "a", "own", "vectors", "limits"])

    parts = max(1, min(PARTS, pages.count()))
    dealt = pages.withColumnRenamed("size", "page_size").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    packs = staged(_packs(anchors, limits), "packs").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = packs.join(dealt, (packs.part == dealt.part) & (F.col("size") == F.col("page_size")))
    return met.select("size", "a", "own", "vectors", "limits", "block", "low_label", "high_label", "low", "high").mapInArrow(run, _NEED)


_FOUND = "a long, w long, score long, id long, row long"


def _read_blocks(need: DataFrame, blocks: DataFrame, pick, k: int) -> DataFrame:
    """``pick``'s rows over all needed blocks: the best k for each anchor and window (``w``), with ``rank``."""
    def best(parts: list[tuple]) -> tuple:
        a, w, score, ids, no_id, rows = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((rows, ids, no_id, -score, w, a))
        a_, w_ = a[order], w[order]
        starts = np.flatnonzero(np.append(True, (a_[1:] != a_[:-1]) | (w_[1:] != w_[:-1])))
        nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        order = order[nth < k]
        return a[order], w[order], score[order], ids[order], no_id[order], rows[order]

    def out(parts: list[tuple]) -> pa.RecordBatch:
        a, w, score, ids, no_id, rows = best(parts)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(w), pa.array(score), pa.array(ids, mask=no_id.astype(bool)), pa.array(rows)],
                                          names=["a", "w", "score", "id", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                block = Block(r)
                a, own = np.frombuffer(r["a"], np.int64), np.frombuffer(r["own"], np.int64)
                vectors = np.frombuffer(r["vectors"], np.float64).reshape(len(a), block.size)
                limits = np.frombuffer(r["limits"], np.int64).reshape(len(a), -1)
                for i, scores in enumerate(exact_scores(vectors, block.data)):
                    for w, at in pick(int(a[i]), int(own[i]), limits[i], scores, block):
                        if len(at):
                            parts.append((np.full(len(at), a[i]), np.full(len(at), w), scores[at], block.ids[at], block.no_id[at], block.rows[at]))
                            n += len(at)
                if n > 200_000:
                    parts = [best(parts)]
                    n = len(parts[0][0])
                    if n > 100_000:
                        yield out(parts)
                        parts, n = [], 0
        if parts:
            yield out(parts)

    read = need.join(blocks.drop("low", "high", "low_label", "high_label", "anchors"), "block").mapInArrow(run, _FOUND)
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return read.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(table: DataFrame, is_anchor: Column, *, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0,
                   positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95) -> DataFrame:
    """For each anchor and positive the best rows of other labels that score ``low_percent`` to ``high_percent`` of the positive.

    ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.
    """
    placed = staged(place_rows(table, is_anchor, key=key, label=label, vector=vector, scale=scale), "placed")
    blocks = staged(build_blocks(placed), "blocks")
    pages = staged(build_pages(blocks), "zone-pages")
    anchors = staged(find_anchors(blocks, positives), "anchors")

    def nearest(a, own, limits, scores, block):
        return [(0, _best_of(scores, np.flatnonzero((block.labels == own) & (block.rows != a)), block, positives))]

    need = needed_blocks(anchors.withColumn("limits", F.array("bound")), "limits", pages, same_label_above)
    found = staged(_read_blocks(need, blocks, nearest, positives).select("a", "score", F.col("id").alias("positive_id")), "positives")

    # three numbers for each window: the positive's score, and the least and largest score inside; in decimals, as sums may be long
    score = F.col("score").cast("decimal(38,0)")
    clamp = lambda x: F.greatest(F.least(x, F.lit(_HIGH)), F.lit(_LOW)).cast("long")
    bounds = [F.col("score"), clamp(F.ceil(score * low_percent / 100)), clamp(F.floor(score * high_percent / 100))]
    windows = found.select("a", "score").distinct().groupBy("a").agg(F.flatten(F.array_sort(F.collect_list(F.array(*bounds)))).alias("some"))
    empty = F.array(*(F.lit(x) for x in (0, 1, 0)))
    padded = F.concat("some", F.flatten(F.array_repeat(empty, positives - (F.size("some") / 3).cast("int"))))
    windowed = anchors.join(windows.select(F.col("a").alias("of"), padded.alias("windows")), F.col("a") == F.col("of"))

    def inside(a, own, limits, scores, block):
        others = np.flatnonzero(block.labels != own)
        for w, low, high in limits.reshape(-1, 3).tolist():
            if low <= high:
                yield w, _best_of(scores, others[(scores[others] >= low) & (scores[others] <= high)], block, negatives)

    need = needed_blocks(windowed, "windows", pages, other_label_within)
    mined = _read_blocks(need, blocks, inside, negatives)
    pairs = found.join(anchors.select("a", "anchor_id"), "a").withColumnRenamed("score", "w")
    return pairs.join(mined, ["a", "w"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                                                F.col("w").alias("positive_score"), F.col("score").alias("negative_score"))
