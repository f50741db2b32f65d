"""Operator 10: byte-level BPE by corpus-level merge replay.

A chunk of documents is a corpus: its distinct pieces (matches of the split pattern) are laid
end to end as symbols, and an inverted index leads from the rank of a symbol pair to the
positions where the pair stands. Every merge is applied once, in rank order, to all of its
positions; only the pairs with the left and right neighbour change and enter the index. A piece
is replayed when a worker first meets it; documents are then put together from their pieces.

Each piece comes out as the usual greedy loop (lowest rank first, leftmost first) would have it.
A merge can make a pair of lower rank than its own only in odd vocabularies; pieces in which that
happens are done again one by one, by that loop.

Defined results: a null or empty text has no ids and decodes to nothing; repeated rows are
encoded each; other columns are not read and may have any names. An id outside the vocabulary
is an error of ``decode``.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from tidegate.llm.common import Shared, offsets, ragged, text_list

#: Bytes of new pieces that are replayed together.
REPLAY_BYTES = 4 << 20
#: Positions of one merge from which they are merged as arrays.
MANY = 32
#: Pieces that a worker remembers before it starts afresh.
KNOWN_PIECES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class MergeReplay:
    """Ids of pieces, by replaying the merges of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        first = [[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]
        self._first = np.array(first, np.int32)
        self._pairs: dict[int, int] = {}

    def _rank(self, left: int, right: int) -> int:
        key = left << 32 | right
        found = self._pairs.get(key)
        if found is None:
            found = self._pairs[key] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return found

    def one(self, piece: bytes) -> list[int]:
        """The greedy loop over a single piece."""
        ids = [int(self._byte[b]) for b in piece]
        while len(ids) > 1:
            rank, at = min(((r, i) for i in range(len(ids) - 1) if (r := self._rank(ids[i], ids[i + 1])) >= 0),
                           default=(-1, -1))
            if rank < 0:
                break
            ids[at : at + 2] = [rank]
        return ids

    def many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and how many each piece has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int32), lengths
        ends = np.cumsum(lengths)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        pair = np.full(n, -1, np.int32)
        pair[:-1] = self._first[data[:-1], data[1:]]
        pair[after < 0] = -1

        at = np.nonzero(pair >= 0)[0]
        at = at[np.argsort(pair[at], kind="stable")]
        present, starts = np.unique(pair[at], return_index=True)
        index = {rank: here.tolist() for rank, here in zip(present.tolist(), np.split(at, starts[1:]))}
        symbols = self._byte[data]
        odd_at = self._apply(index, symbols, after, before, pair)
        alive = symbols >= 0
        counts = np.zeros(len(pieces), np.int64)
        full = lengths > 0
        counts[full] = np.add.reduceat(alive.astype(np.int64), (ends - lengths)[full])
        ids = symbols[alive]
        if odd_at:
            ids, counts = self._again(pieces, ids, counts, np.unique(np.searchsorted(ends, odd_at, side="right")))
        return ids, counts

    def _apply(self, index: dict[int, list[int]], symbols, after, before, pair) -> list[int]:
        """Every merge in rank order, in place (symbol -1: merged away); where a lower rank came up late."""
        odd: list[int] = []
        waiting = list(index)
        heapify(waiting)
        views = tuple(map(memoryview, (symbols, after, before, pair)))
        while waiting:
            rank = heappop(waiting)
            positions = index.pop(rank)
            if len(positions) >= MANY:
                p = np.unique(np.array(positions, np.int32))
                p = p[pair[p] == rank]
                if not (pair[after[p]] == rank).any():  # else two pairs of this rank overlap
                    self._merge_all(rank, p, symbols, after, before, pair, index, waiting, odd)
                    continue
                positions = p.tolist()
            positions.sort()
            self._merge_each(rank, positions, *views, index, waiting, odd)
        return odd

    def _merge_each(self, rank, positions, symbols, after, before, pair, index, waiting, odd) -> None:
        rank_of, pairs = self._rank, self._pairs
        for p in positions:
            if pair[p] != rank:
                continue
            q = after[p]
            t = after[q]
            symbols[p], symbols[q], pair[q], after[p], pair[p] = rank, -1, -1, t, -1
            changed = []
            if t >= 0:
                before[t] = p
                changed.append((p, rank, symbols[t]))
            if (o := before[p]) >= 0:
                changed.append((o, symbols[o], rank))
            for at, left, right in changed:
                key = left << 32 | right
                pair[at] = new = pairs[key] if key in pairs else rank_of(left, right)
                if new >= 0:
                    if new in index:
                        index[new].append(at)
                    else:
                        index[new] = [at]
                        heappush(waiting, new)
                    if new < rank:
                        odd.append(at)

    def _merge_all(self, rank, p, symbols, after, before, pair, index, waiting, odd) -> None:
        """As ``_merge_each`` for positions that do not overlap."""
        q = after[p]
        t = after[q]
        inner = t >= 0
        passing = p[inner][pair[t[inner]] == rank]  # for a moment these stand left of an unmerged pair
        if len(passing):
            between = self._ranks(np.full(len(passing), rank, np.int64), symbols[after[after[passing]]])
            odd.extend(passing[(between >= 0) & (between < rank)].tolist())
        symbols[p], symbols[q], pair[q], after[p], pair[p] = rank, -1, -1, t, -1
        before[t[inner]] = p[inner]
        o = before[p]
        at = np.unique(np.concatenate((p[inner], o[o >= 0])))
        new = self._ranks(symbols[at].astype(np.int64), symbols[after[at]])
        pair[at] = new
        at, new = at[new >= 0], new[new >= 0]
        if not len(at):
            return
        odd.extend(at[new < rank].tolist())
        order = np.argsort(new, kind="stable")
        present, starts = np.unique(new[order], return_index=True)
        for found, here in zip(present.tolist(), np.split(at[order], starts[1:])):
            if found in index:
                index[found].extend(here.tolist())
            else:
                index[found] = here.tolist()
                heappush(waiting, found)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, which = np.unique(left << 32 | right, return_inverse=True)
        found = [self._rank(k >> 32, k & 0xFFFFFFFF) for k in keys.tolist()]
        return np.array(found, np.int32)[which]

    def _again(self, pieces, ids, counts, which) -> tuple[np.ndarray, np.ndarray]:
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in which.tolist():
            parts[i] = np.array(self.one(pieces[i]), np.int32)
            counts[i] = len(parts[i])
        return np.concatenate(parts), counts


class _Codes(dict):
    """A code for each piece, in order of appearance."""

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self)
        return code


class Encoder:
    """Encodes and decodes batches of texts; remembers the pieces it has met."""

    def __init__(self, spec: tuple[dict[bytes, int], str]):
        ranks, pattern = spec
        self.replay = MergeReplay(ranks)
        self._find = regex.compile(pattern).findall
        self._decimal = [str(i).encode() for i in range(len(self.replay.tokens))]
        self._forget()

    def _forget(self) -> None:
        self._codes = _Codes()
        self._ids = np.zeros(0, np.int32)
        self._counts = np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Ids of the pieces that have no ids yet."""
        fresh = list(islice(self._codes, len(self._counts), None))
        ids, counts, at = [self._ids], [self._counts], 0
        while at < len(fresh):
            pieces, size = [], 0
            while at < len(fresh) and size < REPLAY_BYTES:
                pieces.append(fresh[at].encode())
                size += len(pieces[-1])
                at += 1
            whole = [self.replay.ranks.get(p, -1) for p in pieces]  # a piece that is a token stays one
            rest = [p for p, r in zip(pieces, whole) if r < 0]
            got, n = self.replay.many(rest) if rest else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            known = np.array(whole, np.int32)
            count = np.ones(len(pieces), np.int64)
            count[known < 0] = n
            out = np.empty(int(count.sum()), np.int32)
            start = offsets(count)[:-1]
            out[start[known >= 0]] = known[known >= 0]
            out[ragged(start[known < 0], n)] = got
            ids.append(out)
            counts.append(count)
        self._ids, self._counts = np.concatenate(ids), np.concatenate(counts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        if len(self._codes) > KNOWN_PIECES:
            self._forget()
        code_of, codes, sizes = self._codes.__getitem__, array("q"), []
        for text in texts:
            pieces = self._find(text)
            codes.extend(map(code_of, pieces))
            sizes.append(len(pieces))
        self._learn()
        at = np.frombuffer(codes, np.int64)
        n = self._counts[at]
        ids = self._ids[ragged(offsets(self._counts)[at], n)]
        return ids, np.diff(offsets(n)[offsets(np.array(sizes, np.int64))])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, ids))

    def decimals(self, ids: Iterable[int]) -> bytes:
        """The ids in decimal, joined by commas."""
        return b",".join(map(self._decimal.__getitem__, ids))


def shared_encoder(df: DataFrame, ranks_path: str, pattern: str) -> Shared:
    """The vocabulary, read on the driver and sent to executors (about 1 MB for 50,000 tokens)."""
    return Shared(df.sparkSession, (read_ranks(ranks_path), pattern), Encoder)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, key: str = "doc_id", text: str = "text",
           ids: str = "ids") -> DataFrame:
    """``key`` and the ids of each text, as array<int>. One scan, no shuffle."""
    shared = shared_encoder(docs, ranks_path, pattern)
    schema = docs.select(key).schema.add(ids, ArrayType(IntegerType()))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.get()
        for batch in rows:
            flat, counts = encoder.encode(text_list(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(offsets(counts), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, ids])

    return docs.select(docs[key], docs[text].alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, *, key: str = "doc_id", ids: str = "ids",
           text: str = "text") -> DataFrame:
    """``key`` and the bytes that the ids stand for. Null ids decode to nothing."""
    shared = shared_encoder(encoded, ranks_path, pattern)
    schema = encoded.select(key).schema.add(text, "binary")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.get()
        for batch in rows:
            texts = [encoder.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=[key, text])

    return encoded.select(encoded[key], encoded[ids].alias("__ids")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each text's ids and of what they decode to, without moving the ids out of the worker."""
    shared = shared_encoder(docs, ranks_path, pattern)
    schema = (docs.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string")
              .add("decoded_sha256", "string"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.get()
        for batch in rows:
            flat, counts = encoder.encode(text_list(batch.column(1)))
            ends, ids_sha, text_sha = offsets(counts), [], []
            for i in range(len(counts)):
                ids = flat[ends[i] : ends[i + 1]].tolist()
                ids_sha.append(hashlib.sha256(encoder.decimals(ids)).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(ids_sha), pa.array(text_sha)],
                                             names=schema.names)

    return docs.select(docs[key], docs[text].alias("__text")).mapInArrow(run, schema)
