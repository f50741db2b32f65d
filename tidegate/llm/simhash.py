"""Operator 9: SimHash near-duplicates by generalised pigeonhole.

Fingerprints that differ in at most ``radius`` of 64 bits are linked, and links close into groups.
The bits are put into an order in which correlated ones are neighbours, and the order is cut into
parts. If the thresholds T of the parts sum to ``radius - parts + 1`` (a part may have -1), two
linked fingerprints differ in at most T bits in some part. Each fingerprint gets thresholds of its
own: a dynamic programme over the parts takes those with the least estimated work, from histograms
of 8-bit blocks over all fingerprints. It then probes every value within its threshold of its own
value in each part, and what it meets is verified on all 64 bits. The number of parts is the one
with the least estimated work over all fingerprints, so parts widen as the corpus grows.

Only distinct fingerprints are linked, so copies cost one row. Fingerprints that meet in one value
are compared as arrays and come out as a star per group, not as pairs. A value that more than
``HOT`` fingerprints share is not gathered: there, two fingerprints are linked if and only if some
point of the remaining bits lies half way between them, so each names the points around it and a
minimum per point links them, with work linear in their number.

Defined results: a text without words (null, empty, blank) has fingerprint zero and is linked like
any other; fewer words than a shingle form one shingle; repeated rows share their group; a null id
is never the smallest of a group with others; an empty table gives an empty result; other columns
are not read and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidegate.llm.common import Shared, offsets, ragged
from tidegate.llm.components import connected
from tidegate.plans.staging import staged

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints with one value of a part from which on they are linked through half-way points.
HOT = 8192
#: Work of a probe, in verified candidates.
PROBE = 8.0
#: Pairs of one value that are compared as a matrix and come out as stars.
DENSE = 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[9:14] = _IN_WORD[32] = False
_BLOCKS = {2: (4, 4), 3: (3, 3, 2), 4: (2, 2, 2, 2), 5: (2, 2, 2, 1, 1)}  # 8-bit blocks of each part
_MOST = 2  # the largest threshold of a part


# -- fingerprints --------------------------------------------------------------------------------

def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of all texts end to end, and how many each text has."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    n = int(bounds[-1] - bounds[0])
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # one blank after each word
    data[~inside] = 32
    at = np.cumsum(kept) - 1
    starts, ends = np.nonzero(first)[0], np.nonzero(last)[0]
    words = np.diff(np.searchsorted(starts, bounds))
    starts, ends = at[starts], at[ends] + 1
    n_shingles = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    low = ragged(offsets(words)[:-1], n_shingles)
    high = low + np.repeat(np.minimum(words, size), n_shingles) - 1
    line = data[kept].tobytes()
    pieces = map(line.__getitem__, map(slice, starts[low].tolist(), ends[high].tolist()))
    return np.fromiter(map(xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(low)), n_shingles


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, the bits that are set in over half of its hashes."""
    out = np.zeros(len(counts), np.uint64)
    ends = offsets(counts)
    i = 0
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + 200_000, side="right")) - 1)
        full = np.arange(i, j)[counts[i:j] > 0]
        if len(full):
            total = np.zeros((len(full), 64), np.int64)
            for low in range(int(ends[i]), int(ends[j]), 1_000_000):  # a single text may be longer
                part = hashes[low : min(low + 1_000_000, int(ends[j]))]
                bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                inside = (ends[full] < low + len(part)) & (ends[full + 1] > low)
                cut = np.maximum(ends[full[inside]] - low, 0)
                total[inside] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
            over = 2 * total > counts[full][:, None]
            out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)
        i = j
    return out


def fingerprints(docs: DataFrame, *, keys: list[str], text: str = "text", size: int = SHINGLE) -> DataFrame:
    """The key columns and ``fp``, the fingerprint as a signed 64-bit number. One scan, no shuffle."""
    schema = docs.select(*(docs[k] for k in keys)).schema.add("fp", "long")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fp = majority(*shingle_hashes(batch.column(len(keys)), size)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(fp)], names=schema.names)

    return docs.select(*(docs[k] for k in keys), docs[text].alias("__text")).mapInArrow(run, schema)


# -- parts and thresholds ------------------------------------------------------------------------

def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _sums(df: DataFrame, of_batch) -> np.ndarray:
    """The sum of an array of fixed length over all batches of fingerprints."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in rows:
            part = of_batch(batch.column(0).to_numpy())
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(np.float64))], names=["i", "n"])

    found = df.select("fp").mapInArrow(run, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).orderBy("i")
    return np.array([r.n for r in found.collect()])


def bit_order(distinct: DataFrame) -> list[int]:
    """The 64 bits in an order that keeps correlated ones together."""
    def of_batch(fp):
        bits = _bits(fp).astype(np.float64)
        return np.concatenate(((bits.T @ bits).reshape(-1), [len(fp)]))

    sums = _sums(distinct, of_batch)
    if not len(sums):
        return list(range(64))
    both, n = sums[:-1].reshape(64, 64), max(sums[-1], 1.0)
    share = np.diag(both) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    close = np.abs(both / n - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(close, 0)
    order = [int(close.sum(0).argmax())]
    while len(order) < 64:
        near = close[order[-8:]].sum(0)
        near[order] = -1
        order.append(int(near.argmax()))
    return order


class Plan:
    """How fingerprints are cut, and what each part is estimated to meet."""

    def __init__(self, payload: tuple[list[int], np.ndarray, int, int]):
        self.order, histogram, self.parts, self.radius = payload
        n = max(histogram[0].sum(), 1.0)
        apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)).astype(int)
        near = np.stack([(apart == d) @ histogram.T for d in range(_MOST + 1)])  # distance, value, block
        self.near, self.n = near / n, n
        self.sizes = _BLOCKS[self.parts]
        self.widths = [8 * b for b in self.sizes]

    def blocks(self, fp: np.ndarray) -> np.ndarray:
        return np.packbits(_bits(fp)[:, self.order], axis=1, bitorder="little")

    def values(self, blocks: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for size in self.sizes:
            value = np.zeros(len(blocks), np.int64)
            for j in range(size):
                value |= blocks[:, at + j].astype(np.int64) << 8 * j
            out.append(value)
            at += size
        return out

    def work(self, blocks: np.ndarray) -> list[np.ndarray]:
        """For each part, by threshold -1, 0, ..: estimated candidates and probes of each fingerprint."""
        out, at = [], 0
        for size, width in zip(self.sizes, self.widths):
            at_distance = None
            for j in range(at, at + size):
                own = self.near[:, blocks[:, j], j]
                if at_distance is None:
                    at_distance = own
                else:
                    at_distance = np.stack([sum(at_distance[d] * own[t - d] for d in range(t + 1)) for t in range(_MOST + 1)])
            probes = np.cumsum([len(_masks(width, t)) for t in range(_MOST + 1)])
            cost = self.n * np.cumsum(at_distance, axis=0) + PROBE * probes[:, None]
            out.append(np.vstack([np.zeros((1, len(blocks))), cost]))
            at += size
        return out

    def thresholds(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The thresholds (fingerprint, part) of least estimated work, and that work."""
        work, goal = self.work(blocks), self.radius + 1  # sum of (threshold + 1)
        best = np.full((goal + 1, len(blocks)), np.inf)
        best[0] = 0
        taken = []
        for cost in work:
            options = np.full((_MOST + 2, goal + 1, len(blocks)), np.inf)
            for step in range(_MOST + 2):
                options[step, step:] = best[: goal + 1 - step] + cost[step]
            taken.append(options.argmin(0))
            best = options.min(0)
        left, chosen = np.full(len(blocks), goal), []
        for took in reversed(taken):
            step = took[left, np.arange(len(blocks))]
            chosen.append(step - 1)
            left = left - step
        return np.stack(chosen[::-1], axis=1), best[goal]


@lru_cache(maxsize=64)
def _masks(width: int, distance: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), distance)], np.int64)


def make_plan(distinct: DataFrame, radius: int) -> tuple[list[int], np.ndarray, int, int]:
    order = bit_order(distinct)

    def counts(fp):
        blocks = np.packbits(_bits(fp)[:, order], axis=1, bitorder="little")
        return np.concatenate([np.bincount(blocks[:, j], minlength=256) for j in range(8)])

    sums = _sums(distinct, counts)
    histogram = sums.reshape(8, 256) if len(sums) else np.zeros((8, 256))
    cuts = [p for p, blocks in _BLOCKS.items() if radius + 1 <= len(blocks) * (_MOST + 1)]
    plans = [Plan((order, histogram, p, radius)) for p in cuts]

    def work(fp):
        return np.array([p.thresholds(p.blocks(fp))[1].sum() for p in plans])

    totals = _sums(distinct, work)
    return order, histogram, cuts[int(totals.argmin())] if len(totals) else cuts[0], radius


# -- probing -------------------------------------------------------------------------------------

def probe_rows(distinct: DataFrame, shared: Shared) -> DataFrame:
    """``slot`` (part and value), ``fp`` and ``role``: 0 is met there, 1 also probes, 1 + d probes from d bits away."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.get()
        for batch in rows:
            fp = batch.column(0).to_numpy()
            blocks = plan.blocks(fp)
            thresholds, _ = plan.thresholds(blocks)
            for part, value in enumerate(plan.values(blocks)):
                own = thresholds[:, part]
                yield _rows(part, value, fp, (own >= 0).astype(np.int8))
                for d in range(1, int(own.max(initial=0)) + 1):
                    masks, far = _masks(plan.widths[part], d), own >= d
                    values = (value[far][:, None] ^ masks).reshape(-1)
                    yield _rows(part, values, np.repeat(fp[far], len(masks)), np.full(len(values), 1 + d, np.int8))

    return distinct.select("fp").mapInArrow(run, "slot long, fp long, role byte")


def _rows(part: int, value: np.ndarray, fp: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(value | part << 40), pa.array(fp), pa.array(role)], names=["slot", "fp", "role"])


def _dense(fp: np.ndarray, n_met: int, first_probe: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars that link what pairs within the radius would: met ones come first, probing ones last."""
    met, probing = fp[:n_met], fp[first_probe:]
    near = np.empty((len(probing), n_met), bool)
    for i in range(0, len(probing), 512):
        near[i : i + 512] = np.bitwise_count(probing[i : i + 512, None] ^ met) <= radius
    label = np.arange(len(fp))
    while True:
        before = label.copy()
        for i in range(0, len(probing), 512):
            rows = slice(first_probe + i, min(first_probe + i + 512, len(fp)))
            seen = near[i : i + 512]
            label[rows] = np.minimum(label[rows], np.where(seen, label[:n_met], len(fp)).min(axis=1, initial=len(fp)))
            label[:n_met] = np.minimum(label[:n_met], np.where(seen, label[rows][:, None], len(fp)).min(axis=0, initial=len(fp)))
        if (label == before).all():
            break
    other = fp != fp[label]
    yield fp[other], fp[label[other]]


def _links_in(slot: np.ndarray, fp: np.ndarray, role: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows sorted by slot and role."""
    starts = np.flatnonzero(np.diff(slot, prepend=slot[0] - 1))
    sizes = np.diff(np.append(starts, len(slot)))
    met = np.add.reduceat(role <= 1, starts)
    probing = np.add.reduceat(role >= 1, starts)
    pairs = met * probing
    for g in np.flatnonzero(pairs > DENSE).tolist():
        rows = slice(starts[g], starts[g] + sizes[g])
        yield from _dense(fp[rows], int(met[g]), int(sizes[g] - probing[g]), radius)
    few = (pairs > 0) & (pairs <= DENSE) & (sizes > 1)
    query = ragged(starts[few] + sizes[few] - probing[few], probing[few])
    n = np.repeat(met[few], probing[few])
    start = np.repeat(starts[few], probing[few])
    ends = offsets(n)
    i = 0
    while i < len(query):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + 1_000_000, side="right")) - 1)
        left, right = fp[np.repeat(query[i:j], n[i:j])], fp[ragged(start[i:j], n[i:j])]
        near = (left != right) & (np.bitwise_count(left ^ right) <= radius)
        yield left[near], right[near]
        i = j


def _links(probes: DataFrame, radius: int) -> DataFrame:
    """Links from all slots that are gathered; a slot's rows are in one task, one after the other."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            slot, fp, role = (table.column(i).to_numpy() for i in range(3))
            for a, b in _links_in(slot, fp.view(np.uint64), role, radius):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in rows:
            held.append(batch)
            n += batch.num_rows
            if n >= 250_000:
                table = pa.Table.from_batches(held)
                slot = table.column(0).to_numpy()
                cut = int(np.searchsorted(slot, slot[-1]))  # the last slot may go on
                if cut:
                    yield from found(table.slice(0, cut))
                    table = table.slice(cut)
                else:  # more rows probe this slot: go on with those that are met there
                    yield from found(table)
                    table = table.filter(pc.less_equal(table.column(2), 1))
                    table = table.set_column(2, "role", pa.array(np.zeros(table.num_rows, np.int8)))
                held, n = table.to_batches(), table.num_rows
        if n:
            yield from found(pa.Table.from_batches(held))

    return (probes.repartition("slot").sortWithinPartitions("slot", "role").select("slot", "fp", "role")
            .mapInArrow(run, "a long, b long"))


def _hot_links(probes: DataFrame, shared: Shared, radius: int) -> DataFrame:
    """Links of crowded slots through points half way, in the bits outside the slot's part.

    Rows that are met reach half the radius, rows that probe from d bits away what that leaves;
    so two rows meet in a point if, and rows that are met only if, they are linked.
    """
    reach = radius // 2

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.get()
        cuts = offsets(np.array(plan.widths))
        for batch in rows:
            slot, fp, role = (batch.column(i).to_numpy() for i in range(3))
            ordered = plan.blocks(fp).copy().view("<i8").reshape(-1)
            for part in np.unique(slot >> 40).tolist():
                inside = [b for b in range(64) if not cuts[part] <= b < cuts[part + 1]]
                clear = np.array([sum(1 << b for b in inside)], np.uint64).view(np.int64)[0]
                for kind in np.unique(role).tolist():
                    here = (slot >> 40 == part) & (role == kind)
                    own = ordered[here] & clear
                    most = reach if kind <= 1 else radius - (kind - 1) - reach
                    for d in range(most + 1):
                        masks = np.array([sum(1 << inside[b] for b in c) for c in combinations(range(len(inside)), d)],
                                         np.uint64).view(np.int64)
                        step = max(1, 500_000 // len(masks))
                        for i in range(0, len(own), step):
                            points = (own[i : i + step, None] ^ masks).reshape(-1)
                            n = len(points)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.repeat(slot[here][i : i + step], len(masks))), pa.array(points),
                                 pa.array(np.repeat(fp[here][i : i + step], len(masks))), pa.array(np.full(n, kind <= 1))],
                                names=["slot", "point", "fp", "met"])

    points = staged(probes.mapInArrow(run, "slot long, point long, fp long, met boolean"), "points")
    centre = (points.where("met").groupBy("slot", "point").agg(F.min("fp").alias("b")))
    return (points.join(centre, ["slot", "point"]).select(F.col("fp").alias("a"), "b")
            .where(F.expr(f"a <> b and bit_count(a ^ b) <= {radius}")).distinct())


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Links (a, b) of distinct fingerprints whose closure is that of all pairs within the radius."""
    if radius % 2:
        raise ValueError("the radius must be even: crowded values are linked through points half way")
    shared = Shared(distinct.sparkSession, make_plan(distinct, radius), Plan)
    probes = probe_rows(distinct, shared)
    crowded = staged(probes.where("role <= 1").groupBy("slot").count().where(F.col("count") > hot).select("slot"), "crowded")
    if crowded.isEmpty():
        return _links(probes, radius)
    return (_links(probes.join(crowded, "slot", "left_anti"), radius)
            .unionByName(_hot_links(probes.join(crowded, "slot", "left_semi").select("slot", "fp", "role"), shared, radius)))


def near_duplicates(docs: DataFrame, *, keys: list[str], text: str = "text", size: int = SHINGLE, radius: int = RADIUS,
                    hot: int = HOT) -> DataFrame:
    """Key columns, ``fp``, ``group_fp`` (the smallest fingerprint reachable) and ``component_id``.

    ``component_id`` is the smallest first key of the documents reachable, the document itself included.
    """
    prints = staged(fingerprints(docs, keys=keys, text=text, size=size), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min(keys[0]).alias("low")), "distinct")
    groups = connected(link_fingerprints(distinct, radius, hot))
    labels = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    lows = labels.where("root is not null").groupBy("root").agg(F.min("low").alias("group_low"))
    labels = staged(labels.join(lows, "root", "left").select(
        "fp", F.coalesce("root", "fp").alias("group_fp"), F.when(F.col("root").isNull(), F.col("low"))
        .otherwise(F.col("group_low")).alias("component_id")), "labels")
    return prints.join(labels, "fp").select(*keys, "fp", "group_fp", "component_id")


def one_of_each_group(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE,
                      radius: int = RADIUS) -> DataFrame:
    """The documents without near-duplicates: of each group the one with the smallest key stays.

    Rows with one key are told apart by their text's hash, the smaller one coming first; of equal rows one stays.
    """
    names = [c.lower() for c in docs.columns]
    mark = next(c for c in (f"row_hash_{i}" for i in range(len(names) + 1)) if c not in names)
    identity = F.concat_ws("\n", F.coalesce(docs[key].cast("string"), F.lit("")), F.coalesce(docs[text], F.lit("")))
    hashed = docs.withColumn(mark, F.md5(identity))
    groups = near_duplicates(hashed, keys=[key, mark], text=text, size=size, radius=radius)
    first = F.min(F.struct(F.col(key).isNull(), F.col(key), F.col(mark).alias("hash")))
    stay = staged(groups.groupBy("group_fp").agg(first.alias("first")).select("first.hash"), "stay")
    kept = hashed.join(stay, hashed[mark] == stay["hash"], "left_semi")
    return kept.dropDuplicates([mark]).select(*docs.columns)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
