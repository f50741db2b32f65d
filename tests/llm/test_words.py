"""Token counts against the tokenizer library, spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegate.llm import spelling, token_counts
from tidegate.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(SPEC)
#: Pieces at which chunks and words are hard to cut.
HARD = ["'s", "'ll", "'", "''", "llama", "sunday", "<|endoftext|>", "<|startof", "text|>", "é", "e\u0301", "\u0301", "İ", "\u1100", "\u1161",
        "\u11a8", "각", "😀", "1", "23", " ", "\n", "\u3000", "aaaa", "!!!", "中文字", "\x1c", "\x85", "<|", "İ!", "ſ", "ﬁ", "\u0345", "x" * 30]


def whole(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


@pytest.fixture(scope="module")
def small():
    return token_counts.TokenCounter(SPEC, chunk=64, overlap=32)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(HARD), max_size=8), st.lists(st.integers(0, 7), min_size=5, max_size=200))
def test_chunks_and_words_count_like_whole_texts(small, parts, order):
    text = "".join(parts[i % len(parts)] for i in order) if parts else ""
    assert small.count([text]) == [whole(text)] == small._by_words([text])


@pytest.mark.parametrize("text", ["a" * 5_000, "ab!" * 3_000, "the cat's hat " * 2_000, "中文字" * 4_000, "x<|endoftext|>" * 900, "e\u0301" * 2_000,
                                  "a" + "\u0301" * 4_000, "İ" * 3_000, "'s" * 3_000, "9" * 4_000, "\n" * 4_000])
def test_huge_texts(small, text):
    assert small.count([text]) == [whole(text)]


def test_overlaps_are_widened_until_chunks_agree():
    counter = token_counts.TokenCounter(SPEC, chunk=200, overlap=24)
    text = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    assert counter.count([text]) == [whole(text)] and counter.widened > 0


def test_other_builds_are_asked_for_whole_texts():
    assert token_counts.splits(token_counts.json.loads(SPEC))
    other = token_counts.TokenCounter(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(), 64, 32)
    text = "It's  a test.\n\n" * 40
    assert not other.splits and other.count([text]) == [len(other.tokenizer.encode(text, add_special_tokens=False))]


def test_token_counts_of_a_table(spark):
    texts = [None, "", " ", "The cat's <|endoftext|> hat", "é" * 100_000, "word " * 60_000, "The cat's <|endoftext|> hat"]
    table = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "id int, text string, n_tokens string, __text string")
    got = {r.id: tuple(r)[1:] for r in token_counts.count_tokens(table, PATH, 5, keys=["id"]).collect()}
    assert got == {i: (len((t or "").encode()), whole(t), whole(t) > 5) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(table.limit(0), PATH, 5, keys=["id"]).count() == 0


def test_token_counts_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op12_token_counts"](spark, SF).collect()}
    assert got == {r.doc_id: (len((r.text or "").encode()), whole(r.text), whole(r.text) > 2048) for r in rows}


# -- spelling ------------------------------------------------------------------------------------

def counted(rows, every, least_length=6, least=5):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if every and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= least_length and n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and len(b) - len(a) <= 1 and a[i + (len(a) == len(b)) :] == b[i + 1 :]


def grouped(words, factor=5):
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    best = {w: min(own, key=lambda x: (-words[x], x), default=None) for w, own in near.items()}
    form = {w: b if b and words[b] >= factor * words[w] else None for w, b in best.items()}
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def test_words_of_odd_texts(spark):
    rows = [(1, "Straße STRASSE straße×÷ naïveté " * 3), (2, None), (3, ""), (None, "null keys null keyss keyless"), (4, "a" * 70_000 + " abcdefg"),
            (5, "ÀÉÎõü àéîõü ÀÉÎõüÿ"), (5, "ÀÉÎõü àéîõü ÀÉÎõüÿ"), (6, "x" * (spelling.LONG + 5) + " Letters9letters_LETTERS")]
    table = spark.createDataFrame([(k, t, "a", 1) for k, t in rows], "doc_id int, text string, word string, n int").repartition(3)
    for every in (None, 2):
        got = {r.word: r.n for r in spelling.count_words(table, every=every).collect()}
        assert got == counted(rows, every, least=1)
    empty = spelling.spelling_variants(table.limit(0))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0


@pytest.mark.parametrize("split", [2_000, 7])
def test_variants_like_brute_force(spark, split):
    rng = random.Random(3)
    stems = ["".join(rng.choices("abé", k=rng.randint(4, 9))) for _ in range(60)] + ["letter", "aaaaaa", "aaaaaaa", "ababab", "bababa"]
    words = {}
    for stem in stems:
        for _ in range(12):
            w, n = stem, rng.choice([5, 25, 26, 125, 3_000])
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]])
            if len(w) >= 4:
                words[w] = n
    words |= {"chainaa": 5, "chainab": 25, "chainbb": 125, "chainbbz": 625, "chainbz": 625, "chayinbbz": 3_125}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    got = {r.word: tuple(r) for r in spelling.group_variants(table, split=split).collect()}
    assert got == grouped(words)


def test_pivots_are_the_lightest_disjoint_ones():
    rng = random.Random(1)
    for _ in range(200):
        places = sorted(rng.sample(range(9), rng.randint(4, 7)))
        weights = [rng.randint(1, 30) for _ in places]
        pairs = [(weights[i] + weights[j]) for i, j in combinations(range(len(places)), 2) if places[j] - places[i] >= 2]
        chosen = spelling.choose_pivots(places, weights)
        assert places[chosen[1]] - places[chosen[0]] >= 2 and sum(weights[i] for i in chosen) == min(pairs)


def test_variants_of_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.word: tuple(r) for r in QUERIES["op13_spelling"](spark, SF).collect()}
    assert got == grouped(counted(rows, 199))
