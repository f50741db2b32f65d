"""Byte-level BPE and token shards against the tokenizer library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidegate.llm import byte_bpe, token_shards
from tidegate.llm.common import offsets

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TEXTS = [None, "", "   ", "The cat's 1234 cats\n\n don't  ", "ñandú 中文 𝔘 ½ ٣ ſK\x1c\x85", "aaaaaaaa" * 400, "x" * 30_000, "The cat's 1234 cats\n\n don't  "]
ODD = "id long, text string, ids string, __text string, part string, key string, slot string"


def reference(path=RANKS):
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return reference()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in enumerate(TEXTS)], ODD)


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder((byte_bpe.read_ranks(RANKS), PATTERN))


def test_ids_and_round_trip(spark, docs, library):
    encoded = byte_bpe.encode(docs, RANKS, PATTERN, key="id")
    got = {r.id: r.ids for r in encoded.collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    back = {r.id: bytes(r.text) for r in byte_bpe.decode(encoded, RANKS, PATTERN, key="id").collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


def test_digests(docs, library):
    for r in byte_bpe.round_trip(docs, RANKS, PATTERN, key="id").collect():
        ids = library.encode_ordinary(TEXTS[r.id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.id] or "").encode()).hexdigest()


def test_empty_table(docs):
    assert byte_bpe.round_trip(docs.limit(0), RANKS, PATTERN, key="id").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdeghinorst ABé中½1٣.!'\n\t　"), max_size=40), max_size=8))
def test_any_text(encoder, library, texts):
    flat, counts = encoder.encode(texts)
    ends = offsets(counts)
    assert [flat[ends[i] : ends[i + 1]].tolist() for i in range(len(texts))] == [library.encode_ordinary(t) for t in texts]


def test_vocabularies_whose_merges_come_out_of_order():
    """Random ranks make pairs of lower rank than the merge that made them."""
    rng = random.Random(5)
    for _ in range(20):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 330:
            tokens.add(bytes(rng.choices(b"abc", k=rng.randint(2, 6))))
        longer = sorted(t for t in tokens if len(t) > 1)
        rng.shuffle(longer)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(longer)}
        replay = byte_bpe.MergeReplay(ranks)
        pieces = [bytes(rng.choices(b"abc", k=rng.randint(1, 30))) for _ in range(300)] + [b"abcab" * 40, b"a" * 77]
        ids, counts = replay.many(pieces)
        ends = offsets(counts)
        assert [ids[ends[i] : ends[i + 1]].tolist() for i in range(len(pieces))] == [replay.one(p) for p in pieces]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_is_a_bijection(n):
    order = token_shards.Permutation(n, 11)
    slots = order.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (order.number(slots) == np.arange(n)).all()
    if n > 100:
        assert (token_shards.Permutation(n, 12).slot(np.arange(n)) != slots).any()


def test_shards_hold_every_sequence_once(spark, docs, library, monkeypatch):
    monkeypatch.setattr(token_shards, "SHARD", 64)
    monkeypatch.setattr(token_shards, "BLOCK", 16)
    blocks = token_shards.shards(docs.repartition(3), RANKS, PATTERN, end=50256, seed=7, length=16, key="id").cache()
    rows = blocks.collect()
    assert all(len(r.payload) == r.n * r.stride and r.stride == 32 for r in rows)
    assert [r.first_slot for r in rows] == sorted(r.first_slot for r in rows)
    read = {r.slot: r for r in token_shards.read_from(blocks).collect()}
    want = {}
    for i, t in enumerate(TEXTS):
        ids = [*library.encode_ordinary(t or ""), 50256]
        want |= {(i, k // 16): ids[k : k + 16] for k in range(0, len(ids), 16)}
    assert sorted(read) == list(range(len(want)))
    assert {(r.key, r.part): r.ids for r in read.values()} == want
    some = token_shards.read_from(blocks, 21, 30).collect()
    assert sorted(r.slot for r in some) == list(range(21, 51)) and all(r == read[r.slot] for r in some)


def test_order_is_that_of_files_and_rows(spark, tmp_path, monkeypatch):
    """The same slots under two split sizes and with files gathered in tasks in other ways; gapless, and each file in order."""
    monkeypatch.setattr(token_shards, "BLOCK", 16)
    path = str(tmp_path / "docs")
    rows = spark.range(0, 3000, numPartitions=3).select("id", F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word ")), 40).alias("text"))
    rows.withColumn("_metadata", F.lit("clash")).write.option("parquet.block.size", 8 << 10).option("parquet.page.row.count.limit", 100).parquet(path)
    got, parts = [], set()
    for split, cost in (("16k", "0"), ("1m", "1m"), ("64m", "4m")):
        old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
        try:
            for k, v in zip(old, (split, cost)):
                spark.conf.set(k, v)
            docs = spark.read.parquet(path)
            parts.add(docs.rdd.getNumPartitions())
            blocks = token_shards.shards(docs, RANKS, PATTERN, end=50256, seed=7, length=16, key="id")
            got.append(sorted((r.slot, r.key, r.part) for r in token_shards.read_from(blocks).collect()))
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
    assert len(parts) >= 2 and got[0] == got[1] == got[2]
    assert [slot for slot, *_ in got[0]] == list(range(len(got[0])))


def test_no_shards_of_an_empty_table(docs):
    assert token_shards.shards(docs.limit(0), RANKS, PATTERN, end=50256, seed=7, key="id").count() == 0
