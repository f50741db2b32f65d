"""Operator 3: language identification with bit-sliced Bloom filters.

Training counts letter trigrams (a letter with its neighbours, a word's ends as blanks) of every
labelled text by language. A trigram belongs to each language in which its share comes near its
largest share. The filters of all languages share their hash functions and lie bit-sliced in one
table: a slot holds the mask of the languages that set it, so the ``HASHES`` slots of a trigram,
and-ed, give all languages that contain it at once. A document's trigrams are looked up, their
masks counted bit by bit, and each count corrected by the false positives that the filter's fill
lets expect. The language with the largest corrected count is predicted; its share of the
document's trigrams is the score.

All counts are shuffles with partial sums. What is collected and broadcast is the table: at most
``MAX_SLOTS`` slots of one 64-bit word per 64 languages; beyond that size only the false-positive
rate grows, and it is corrected for.

Defined results: a null text or one without letters is ``und`` with score 0; a text of unknown
trigrams only gets the most frequent learned language and score 0; without any labelled text all
are ``und``; equal counts go to the language that sorts first; a null id counts as the empty text;
repeated rows are learned and predicted each; other columns are not read and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import Shared, text_list
from tidegate.plans.staging import staged

UNDETERMINED = "und"
HASHES = 3
MAX_SLOTS = 1 << 22
#: A trigram belongs to a language if its share there is at least this part of its largest share.
NEAR = 0.25
#: Occurrences from which on a trigram is learned.
LEAST = 3
#: Characters of text that are worked on together; longer texts are cut. They take some 40 bytes each.
CHUNK = 1 << 18
#: Distinct trigrams that a task counts before it hands them on.
COUNTED = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank."""
    table = np.full(0x110000, 32, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of all texts end to end as 63-bit numbers, and how many each text has."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    points = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le"), np.uint32)
    codes = np.concatenate(([32], _letters()[points], [32])).astype(np.int64)
    at = np.flatnonzero(codes != 32)
    grams = codes[at - 1] << 42 | codes[at] << 21 | codes[at + 1]
    return grams, np.diff(np.searchsorted(at - 1, np.concatenate(([0], np.cumsum(lengths)))))


def chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunk by chunk: numbers of texts, the trigrams of their pieces end to end, and how many each piece has.

    A piece carries a character of the text on either side, so a cut loses no trigram and makes none.
    """
    def counted() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams, n = trigrams(pieces)
        ends, kept = np.cumsum(n), np.ones(len(grams), bool)
        before = np.array([left and p[0].isalpha() for p, left in zip(pieces, lefts)], bool)
        after = np.array([right and p[-1].isalpha() for p, right in zip(pieces, rights)], bool)
        kept[(ends - n)[before]] = False
        kept[ends[after] - 1] = False
        return np.array(numbers), grams[kept], n - before - after

    numbers, pieces, lefts, rights, size = [], [], [], [], 0
    for i, text in enumerate(texts):
        for start in range(0, len(text), CHUNK):
            end = start + CHUNK
            numbers.append(i)
            pieces.append(text[max(start - 1, 0) : end + 1])
            lefts.append(start > 0)
            rights.append(end < len(text))
            size += len(pieces[-1])
            if size >= CHUNK:
                yield counted()
                numbers, pieces, lefts, rights, size = [], [], [], [], 0
    if pieces:
        yield counted()


def _slots(grams: np.ndarray, size: int) -> list[np.ndarray]:
    """The slots of each trigram, one array for each hash function; size is a power of two."""
    x = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    step = (x >> np.uint64(40)) | np.uint64(1)
    return [((x + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]


def count_trigrams(labelled: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang``, ``gram`` and ``n`` over all texts."""
    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return grams, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(name: str) -> pa.RecordBatch:
            grams, n = summed(held.pop(name))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(n)],
                                              names=["lang", "gram", "n"])

        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in rows:
            langs, texts = np.array(batch.column(0).to_pylist(), object), text_list(batch.column(1))
            for name in sorted(set(langs)):
                for _, grams, _ in chunks([texts[i] for i in np.flatnonzero(langs == name)]):
                    own = held.setdefault(name, [])
                    own.append(np.unique(grams, return_counts=True))
                    if sum(len(p[0]) for p in own) > COUNTED:
                        held[name] = [summed(own)]
                        if len(held[name][0][0]) > COUNTED // 2:
                            yield out(name)
            while sum(len(p[0]) for parts in held.values() for p in parts) > 2 * COUNTED:  # of many languages
                yield out(max(held, key=lambda x: sum(len(p[0]) for p in held[x])))
        for name in list(held):
            yield out(name)

    named = labelled.where(labelled[lang].isNotNull()).select(labelled[lang].cast("string"), labelled[text].alias("__text"))
    return named.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """The bit-sliced filters of all languages."""

    def __init__(self, payload: tuple[list[str], int, int, np.ndarray]):
        self.langs, self.most_frequent, self.size, self.table = payload
        bits = [(self.table[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1) for j in range(len(self.langs))]
        self.false = np.array([b.mean() ** HASHES for b in bits])

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """The languages that contain each trigram, as rows of 64-bit masks."""
        first, *others = _slots(grams, self.size)
        out = self.table[first]
        for slot in others:
            out &= self.table[slot]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        n, counts = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        for at, grams, sizes in chunks(texts):
            masks = self.masks(grams)
            at, starts = at[sizes > 0], (np.cumsum(sizes) - sizes)[sizes > 0]
            np.add.at(n, at, sizes[sizes > 0])
            for j in range(len(self.langs) if len(starts) else 0):
                bit = (masks[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)
                np.add.at(counts[:, j], at, np.add.reduceat(bit.astype(np.int64), starts))
        full = n > 0
        true = np.maximum((counts - n[:, None] * self.false) / np.maximum(1 - self.false, 1e-9), 0)
        best = true.argmax(axis=1)
        top = true[np.arange(len(texts)), best]
        best[top == 0] = self.most_frequent
        langs = [self.langs[b] if k else UNDETERMINED for b, k in zip(best.tolist(), full.tolist())]
        return langs, np.where(full, np.minimum(top / np.maximum(n, 1), 1.0), 0.0)


def train(labelled: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], int, int, np.ndarray]:
    """The filters, as a payload for ``Filters``."""
    counts = staged(count_trigrams(labelled, lang, text), "trigrams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return [], 0, 1, np.zeros((1, 1), np.uint64)
    number = F.create_map(*[F.lit(x) for i, name in enumerate(langs) for x in (name, i)])
    total = F.create_map(*[F.lit(x) for name in langs for x in (name, float(totals[name]))])
    shares = (counts.select("gram", "n", number[F.col("lang")].alias("bit"), (F.col("n") / total[F.col("lang")]).alias("share"))
              .groupBy("gram").agg(F.sum("n").alias("n"), F.max("share").alias("top"), F.collect_list(F.struct("bit", "share")).alias("langs"))
              .where(F.col("n") >= LEAST)
              .select("gram", F.inline("langs"), "top").where(F.col("share") >= NEAR * F.col("top")).select("gram", "bit"))
    size = 1 << max(10, (16 * counts.select("gram").distinct().count()).bit_length())
    size = min(size, MAX_SLOTS)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            grams, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            mask = (np.uint64(1) << (bit % 64).astype(np.uint64)).view(np.int64)
            for slot in _slots(grams, size):
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bit // 64), pa.array(mask)], names=["slot", "word", "mask"])

    filled = (shares.mapInArrow(run, "slot long, word int, mask long").groupBy("slot", "word")
              .agg(F.bit_or("mask").alias("mask")).toArrow())
    table = np.zeros((size, (len(langs) + 63) // 64), np.uint64)
    slot, word, mask = (filled.column(i).to_numpy() for i in range(3))
    table[slot, word] = mask.view(np.uint64)
    return langs, langs.index(max(langs, key=lambda name: totals[name])), size, table


def identify(docs: DataFrame, filters: tuple, *, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns, ``lang_pred`` and ``score``. One scan, no shuffle."""
    shared = Shared(docs.sparkSession, filters, Filters)
    schema = docs.select(*(docs[k] for k in keys)).schema.add("lang_pred", "string").add("score", "double")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.get()
        for batch in rows:
            langs, scores = own.predict(text_list(batch.column(len(keys))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], pa.array(langs, pa.string()), pa.array(scores)],
                names=schema.names)

    return docs.select(*(docs[k] for k in keys), docs[text].alias("__text")).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4 == 2


def drop_undetermined(docs: DataFrame, filters: tuple, least: float, *, text: str = "text") -> DataFrame:
    """The documents in a learned language: not ``und``, and at least this share of known trigrams. One scan, no shuffle."""
    shared = Shared(docs.sparkSession, filters, Filters)
    at = docs.columns.index(text)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.get()
        for batch in rows:
            langs, scores = own.predict(text_list(batch.column(at)))
            yield batch.filter(pa.array([s >= least and name != UNDETERMINED for name, s in zip(langs, scores.tolist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
