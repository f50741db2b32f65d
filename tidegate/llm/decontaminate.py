"""Operator 1: benchmark decontamination on a positional inverted index.

The index is dealt out by documents. A segment holds the postings of about ``SEGMENT_BYTES`` of
text: its distinct terms, how often each occurs, and, term after term, the sorted positions of
its words. It is one row of a table in the shared folder, so it is written once and searched by
any number of test sets. A document lies whole in one segment, so searching needs no shuffle, and
a frequent term only lengthens lists that each segment bounds.

Test items are cut into windows. In each segment a window's candidates are the positions of its
rarest term, less that term's offset; the lists of its other terms, the next rarest first, are
intersected with them after the same shift. What is left are exact phrase matches. Proximity
matches take the rarest term's positions as anchors and ask every other list for a position near
by. Test sets come in blocks of at most ``BLOCK_BYTES`` of text, so what is sent to the executors
is bounded, and any number of blocks is searched.

Defined results: null and empty texts and texts without words have no words and no hits; an item
without words has no windows; an empty test set hits nothing; repeated documents are judged each,
repeated item ids count as one item; a null item id is listed as the empty string; other columns
are not read and may have any names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from tidegate.llm.common import Shared, batches_of, offsets, ragged
from tidegate.plans.staging import staged

SEGMENT_BYTES = 12 << 20
BLOCK_BYTES = 4 << 20
#: Candidates that one step of a search holds at a time.
CANDIDATES = 2_000_000

_SPANS = ArrayType(StructType().add("first", "long").add("end", "long"))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)  # of lower-cased bytes: 0-9, a-z and all of other scripts
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts end to end, and how many each text has."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    n = int(bounds[-1] - bounds[0])
    if n == 0:
        return pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.nonzero(first)[0]
    lengths = np.nonzero(last)[0] + 1 - starts
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets(lengths)), pa.py_buffer(data[inside])])
    return words, np.diff(np.searchsorted(starts, bounds))


# -- index ---------------------------------------------------------------------------------------

def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each segment: its documents and the postings of all their words."""
    schema = (docs.select(F.lit("").alias("segment"), F.array(docs[key]).alias("keys")).schema
              .add("words", ArrayType(LongType())).add("terms", "binary").add("term_lengths", "binary")
              .add("counts", "binary").add("postings", "binary"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_of(rows, lambda n, size: size >= SEGMENT_BYTES, "__text"):
            words, n = words_of(part.column("__text").combine_chunks())
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy()
            # one unused position after each document keeps phrases from running into the next
            at = np.arange(len(codes), dtype=np.int32) + np.repeat(np.arange(len(n), dtype=np.int32), n)
            counts = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32)
            postings = at[np.argsort(codes, kind="stable")]
            lengths = pc.binary_length(coded.dictionary).to_numpy().astype(np.int32)
            blobs = (_bytes_of(coded.dictionary), lengths.tobytes(), counts.tobytes(), _pack(postings, counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), _one_list(part.column(0).combine_chunks()), _one_list(pa.array(n)),
                 *(pa.array([b], pa.binary()) for b in blobs)], names=schema.names)

    return docs.select(docs[key].alias("__key"), docs[text].alias("__text")).mapInArrow(run, schema)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _bytes_of(values: pa.Array) -> bytes:
    bounds = np.frombuffer(values.buffers()[1], np.int64)
    return values.buffers()[2].to_pybytes()[: bounds[len(values)]] if len(values) else b""


def _pack(postings: np.ndarray, counts: np.ndarray) -> bytes:
    """Gaps between a term's positions, byte by byte of their four, which compresses well."""
    gaps = np.diff(postings, prepend=np.int32(0))
    heads = offsets(counts)[:-1]
    gaps[heads] = postings[heads]
    return gaps.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(packed: bytes, counts: np.ndarray) -> np.ndarray:
    gaps = np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<i4").reshape(-1).astype(np.int64)
    sums = np.cumsum(gaps)
    heads = offsets(counts)[:-1]
    return sums - np.repeat(sums[heads] - gaps[heads], counts)


class Segment:
    """The postings of one segment, as sorted keys (term, position)."""

    def __init__(self, row: dict):
        self.counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.docs = np.array(row["words"], np.int64)
        self.starts = offsets(self.docs)[:-1] + np.arange(len(self.docs))  # of documents, by position
        self.size = int(self.docs.sum()) + len(self.docs) + 1
        self.postings = _unpack(row["postings"], self.counts)
        self.heads = offsets(self.counts)
        self.keys = np.repeat(np.arange(len(self.counts)) * self.size, self.counts) + self.postings
        lengths = np.frombuffer(row["term_lengths"], np.int32).astype(np.int64)
        self.terms = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets(lengths)), pa.py_buffer(row["terms"])])

    def codes(self, vocabulary: pa.Array) -> np.ndarray:
        """The segment's code of each word, -1 if it has none."""
        return pc.fill_null(pc.index_in(vocabulary, value_set=self.terms), -1).to_numpy().astype(np.int64)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        want = term * self.size + position
        at = np.searchsorted(self.keys, want)
        return self.keys[np.minimum(at, len(self.keys) - 1)] == want

    def next_at(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The term's first position from the given one on; past the segment if there is none."""
        at = np.searchsorted(self.keys, term * self.size + position)
        found = self.keys[np.minimum(at, len(self.keys) - 1)] - term * self.size
        return np.where((at < self.heads[term + 1]), found, self.size)

    def doc_at(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1

    def anchors(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For windows (rows of terms), from the rarest term: window numbers, its positions, and the order of terms."""
        if not len(terms) or not len(self.keys):
            return
        order = np.argsort(self.counts[terms], axis=1, kind="stable")
        rarest = terms[np.arange(len(terms)), order[:, 0]]
        n = self.counts[rarest]
        part = np.cumsum(n) // CANDIDATES  # windows with at most about so many candidates together
        for k in np.unique(part):
            rows = np.nonzero(part == k)[0]
            many = int(n[rows].sum())
            window = np.repeat(rows, n[rows])
            at = self.heads[rarest[rows]]
            for lo in range(0, many, CANDIDATES):
                here = slice(lo, min(many, lo + CANDIDATES))
                yield window[here], self.postings[ragged(at, n[rows])[here]], order


# -- test items ----------------------------------------------------------------------------------

class Items:
    """A block of test items: their distinct words and their windows, grouped by length."""

    def __init__(self, payload: tuple[list, list[bytes], int]):
        self.ids, texts, window = payload
        words, counts = words_of(pa.array(texts, pa.large_binary()))
        coded = words.dictionary_encode()
        self.vocabulary, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        lengths = np.minimum(counts, window)
        n = np.where(counts > 0, counts - lengths + 1, 0)
        item = np.repeat(np.arange(len(counts)), n)
        offset = ragged(np.zeros(len(n), np.int64), n)
        start = offsets(counts)[:-1][item] + offset
        self.groups = []
        for length in np.unique(lengths[item]).tolist():
            own = lengths[item] == length
            self.groups.append((length, item[own], offset[own], codes[start[own][:, None] + np.arange(length)]))


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[tuple[list, list[bytes]]]:
    """Item ids and texts in blocks of at most ``BLOCK_BYTES`` (or a single longer text); at least one block."""
    ids, texts, size, any_block = [], [], 0, False
    for item_id, body in items.select(items[key], F.coalesce(items[text], F.lit(""))).toLocalIterator():
        data = body.encode()
        if ids and size + len(data) > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size, any_block = [], [], 0, True
        ids.append(item_id)
        texts.append(data)
        size += len(data)
    if ids or not any_block:
        yield ids, texts


def _search_blocks(index: DataFrame, items: DataFrame, item_key: str, item_text: str, window: int, run, schema) -> DataFrame:
    def one(block) -> DataFrame:
        shared = Shared(index.sparkSession, (*block, window), Items)

        def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = shared.get()
            for batch in rows:
                for i in range(batch.num_rows):
                    row = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "keys"}
                    yield from run(Segment(row), row["segment"], batch.column("keys")[i].values, tests)

        return index.mapInArrow(search, schema)

    return reduce(DataFrame.unionByName, map(one, item_blocks(items, item_key, item_text)))


def _phrases(segment: Segment, tests: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Item numbers, offsets in the item, positions and length of exact matches."""
    code = segment.codes(tests.vocabulary)
    for length, item, offset, words in tests.groups:
        terms = code[words]
        there = (terms >= 0).all(axis=1)
        terms, item, offset = terms[there], item[there], offset[there]
        for window, position, order in segment.anchors(terms):
            start = position - order[window, 0]
            window, start = window[start >= 0], start[start >= 0]
            for k in range(1, length):
                if not len(window):
                    break
                place = order[window, k]
                kept = segment.has(terms[window, place], start + place)
                window, start = window[kept], start[kept]
            if len(window):
                yield item[window], offset[window], start, length


def _key_type(index: DataFrame):
    return index.schema["keys"].dataType.elementType


def phrase_matches(index: DataFrame, items: DataFrame, window: int = 13, *, key: str = "doc_id", item_key: str = "item_id",
                   item_text: str = "text") -> DataFrame:
    """Every exact match: document, item, first word in the item and in the document, words."""
    schema = (index.select(F.lit(None).cast(_key_type(index)).alias(key)).schema.add(item_key, items.schema[item_key].dataType)
              .add("item_word", "long").add("doc_word", "long").add("n_words", "long"))
    id_type = to_arrow_type(items.schema[item_key].dataType)

    def run(segment: Segment, _name, keys: pa.Array, tests: Items) -> Iterator[pa.RecordBatch]:
        for item, offset, start, length in _phrases(segment, tests):
            doc = segment.doc_at(start)
            ids = pa.array([tests.ids[i] for i in item.tolist()], id_type)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(doc)), ids, pa.array(offset), pa.array(start - segment.starts[doc]),
                 pa.array(np.full(len(doc), length))], names=schema.names)

    return _search_blocks(index, items, item_key, item_text, window, run, schema)


def proximity_matches(index: DataFrame, items: DataFrame, slop: int, window: int = 13, *, key: str = "doc_id",
                      item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Places where all words of a window stand near its rarest word: at most ``slop`` words before or after it.

    ``doc_word`` is the place of that word in the document, ``item_word`` the window's first word in the item.
    """
    schema = (index.select(F.lit(None).cast(_key_type(index)).alias(key)).schema.add(item_key, items.schema[item_key].dataType)
              .add("item_word", "long").add("doc_word", "long"))
    id_type = to_arrow_type(items.schema[item_key].dataType)

    def run(segment: Segment, _name, keys: pa.Array, tests: Items) -> Iterator[pa.RecordBatch]:
        code = segment.codes(tests.vocabulary)
        for length, item, offset, words in tests.groups:
            terms = code[words]
            there = (terms >= 0).all(axis=1)
            terms, item_of, first = terms[there], item[there], offset[there]
            for row, position, order in segment.anchors(terms):
                for k in range(1, length):
                    if not len(row):
                        break
                    doc = segment.doc_at(position)
                    low = np.maximum(position - slop, segment.starts[doc])
                    high = np.minimum(position + slop, segment.starts[doc] + segment.docs[doc] - 1)
                    kept = segment.next_at(terms[row, order[row, k]], low) <= high
                    row, position = row[kept], position[kept]
                if len(row):
                    doc = segment.doc_at(position)
                    ids = pa.array([tests.ids[i] for i in item_of[row].tolist()], id_type)
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(doc)), ids, pa.array(first[row]), pa.array(position - segment.starts[doc])],
                        names=schema.names)

    return _search_blocks(index, items, item_key, item_text, window, run, schema)


def hit_documents(index: DataFrame, items: DataFrame, window: int = 13, *, key: str = "doc_id", item_key: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """Every document with its words, the merged spans of words inside matches, and the items that matched."""
    schema = (index.select("segment", F.lit(0).cast("long").alias("ordinal"), F.lit(None).cast(_key_type(index)).alias(key))
              .schema.add("n_words", "long").add("spans", _SPANS).add("items", ArrayType(StringType())))

    def run(segment: Segment, name: str, keys: pa.Array, tests: Items) -> Iterator[pa.RecordBatch]:
        change, hits = np.zeros(segment.size + 1, np.int64), []
        for item, _, start, length in _phrases(segment, tests):
            np.add.at(change, start, 1)
            np.add.at(change, start + length, -1)
            hits.append(np.unique(segment.doc_at(start) * len(tests.ids) + item))
        inside = np.cumsum(change) > 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, end = edge[::2], edge[1::2]
        doc = segment.doc_at(first)
        n = len(segment.docs)
        spans = pa.StructArray.from_arrays([pa.array(first - segment.starts[doc]), pa.array(end - segment.starts[doc])],
                                           names=["first", "end"])
        hit = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        names = ["" if i is None else str(i) for i in tests.ids]
        items_hit = pa.array([names[i] for i in (hit % max(1, len(names))).tolist()], pa.string())
        hit_doc = hit // max(1, len(names))
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * n, pa.string()), pa.array(np.arange(n)), keys, pa.array(segment.docs),
             pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), spans),
             pa.ListArray.from_arrays(pa.array(np.searchsorted(hit_doc, np.arange(n + 1)), pa.int32()), items_hit)],
            names=schema.names)

    found = _search_blocks(index, items, item_key, item_text, window, run, schema)
    return (found.groupBy("segment", "ordinal")
            .agg(F.first(key).alias(key), F.first("n_words").alias("n_words"),
                 F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
                 F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
            .drop("segment", "ordinal"))


def covered_words(spans: Column) -> Column:
    """The words in sorted spans that may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(spans, start, lambda a, s: F.struct(
        (a.n + F.greatest(s.end - F.greatest(s.first, a.end), F.lit(0))).alias("n"), F.greatest(a.end, s.end).alias("end")),
        lambda a: a.n)


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, one_in: int = 20, *, key: str = "doc_id",
                  text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each document with its hit words and items; contaminated if at least one word in ``one_in`` is hit."""
    index = staged(build_index(docs, key=key, text=text), "postings")
    found = hit_documents(index, items, window, key=key, item_key=item_key, item_text=item_text)
    n_hit = covered_words(F.col("spans"))
    return found.select(key, "n_words", n_hit.alias("n_hit"), "items", "spans").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 13, one_in: int = 20, *, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """The documents that are not contaminated. Each row is judged by its own text, whatever other rows have its key."""
    names = [c.lower() for c in docs.columns]
    mark = next(c for c in (f"row_hash_{i}" for i in range(len(names) + 1)) if c not in names)
    identity = F.concat_ws("\n", F.coalesce(docs[key].cast("string"), F.lit("")), F.coalesce(docs[text], F.lit("")))
    hashed = docs.withColumn(mark, F.unhex(F.md5(identity)))
    found = contamination(hashed, items, window, one_in, key=mark, text=text)
    gone = staged(found.where("contaminated").select(F.col(mark).alias("gone")).distinct(), "contaminated")
    return hashed.join(gone, hashed[mark] == gone["gone"], "left_anti").select(*docs.columns)
