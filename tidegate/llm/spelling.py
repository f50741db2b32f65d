"""Operator 13: grouping of spelling variants by pivotal grams.

The bigrams of a word are put in a global order, rare ones first. The prefix of a word is its three rarest
bigrams (with all that are as rare as the third). One edit spoils at most two neighbouring bigrams, so of two
disjoint ones it leaves one whole: these are the word's pivots, chosen from its three rarest by dynamic
programming for the shortest lists. If two words are one edit apart, a pivot of the word whose prefix ends
earlier in the order stands in the other's prefix. Its place is limited too: a replaced letter moves nothing, an
inserted or deleted one moves what follows it by one. So pivots are looked up by bigram, place and length in an
index of all prefixes, five lookups for a pivot, and what is met is verified by edit distance.

Words are counted in the tasks before the shuffle. The order of bigrams is sent to all tasks: the alphabet has
90 letters, so there are at most 8,100. Lists of the index longer than ``SPLIT`` are dealt out over parts and
asked in each, so a bigram that most words share is not met in one task. Nothing is capped.

A word's form is its most frequent near word, if that is ``factor`` times as frequent. Following forms to the
last one gives the root. Counts grow by that factor at each step, so chains are as long as the logarithm of
the largest count; they are followed by doubling, in a number of joins that is the logarithm of that.

Defined results: a null or empty text has no words; a null key reads as empty where words are thinned; repeated rows
are counted each; equal counts go to the word that is smaller in code-point order; an empty table gives an empty
result; other columns are not read and may have any names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import methodcaller
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import Shared
from tidegate.plans.staging import staged

GRAM = 2
EDITS = 1
#: Bigrams of a prefix: one more than the edits can spoil.
PREFIX = EDITS * GRAM + 1
#: Letters that words are made of.
LETTERS = "A-Za-zÀ-ÿ"
#: Index entries of one bigram, place and length that are met together.
SPLIT = 2_000
#: Words, and their characters, that a task counts before it hands them on.
COUNTED_WORDS = 200_000
COUNTED_CHARACTERS = 8 << 20
#: Characters from which on a text's words are counted as they are found.
LONG = 1 << 20

_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
_KEY = ["gram", "place", "length"]


def thinned_word(word: str, key_crc: int, every: int) -> str:
    """The word, or with one letter less where the hash of key and word is a multiple of ``every``."""
    h = zlib.crc32(word.encode(), key_crc)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_length: int = 6,
                every: int | None = None) -> DataFrame:
    """``word`` and ``n`` over all texts: runs of letters, A to Z in lower case, of ``least_length`` letters or more.

    With ``every`` a letter is taken from the words of one in so many (key, word) hashes, as a typist might.
    """
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def out(found: dict[str, int]) -> Iterator[pa.RecordBatch]:
        words = list(found)
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([found[w] for w in part], pa.int64())],
                                             names=["word", "n"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        size = 0
        for batch in rows:
            keys = batch.column(0).to_pylist()
            for i, own in enumerate(keys):
                string = batch.column(1)[i].as_py() or ""
                raw = Counter(runs.findall(string) if len(string) < LONG else map(methodcaller("group"), runs.finditer(string)))
                crc = zlib.crc32(f"{'' if own is None else own}:".encode())
                for word, n in raw.items():
                    word = word.lower() if word.isascii() else word.translate(_LOWER)
                    if every is not None:
                        word = thinned_word(word, crc, every)
                        if len(word) < least_length:
                            continue
                    if word not in total:
                        size += len(word)
                    total[word] += n
                if len(total) > COUNTED_WORDS or size > COUNTED_CHARACTERS:
                    yield from out(total)
                    total, size = Counter(), 0
        yield from out(total)

    texts = docs.select(docs[key].cast("string").alias("__key"), docs[text].alias("__text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """The place in the order, and the number in all words, of each bigram; at most the alphabet squared."""
    grams = F.transform(F.sequence(F.lit(1), F.char_length("word") - (GRAM - 1)), lambda i: F.substring("word", i, F.lit(GRAM)))
    counts = words.where(F.char_length("word") >= GRAM).select(F.explode(grams).alias("gram")).groupBy("gram").count()
    rows = sorted((r["count"], r["gram"]) for r in counts.collect())
    return {gram: (i, n) for i, (n, gram) in enumerate(rows)}


def choose_pivots(places: list[int], weights: list[int], want: int = EDITS + 1) -> list[int]:
    """Disjoint bigrams with the least sum of weights, as indices; places ascend.

    ``best[k]`` holds, after i bigrams, the least weight of k disjoint ones among them and their indices.
    """
    none = (math.inf, ())
    best = [[(0, ())] + [none] * want]
    for i, (place, weight) in enumerate(zip(places, weights)):
        free = next((j for j in range(i - 1, -1, -1) if places[j] <= place - GRAM), -1) + 1  # bigrams that end before this one
        row = list(best[i])
        for k in range(1, want + 1):
            before, chosen = best[free][k - 1]
            row[k] = min(row[k], (before + weight, (*chosen, i)))
        best.append(row)
    return list(best[-1][want][1])


def signature(word: str, order: dict[str, tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
    """Prefix and pivots of a word as (bigram, place), and where the prefix ends in the order."""
    grams = [order[word[i : i + GRAM]] for i in range(len(word) - GRAM + 1)]
    ranked = sorted(range(len(grams)), key=lambda i: (grams[i][0], i))
    last = grams[ranked[PREFIX - 1]][0]
    prefix = [i for i in ranked if grams[i][0] <= last]
    rarest = sorted(ranked[:PREFIX])
    pivots = [rarest[j] for j in choose_pivots(rarest, [grams[i][1] for i in rarest])]
    return [(grams[i][0], i) for i in prefix], [(grams[i][0], i) for i in pivots], last


def _entries(words: DataFrame, order: Shared) -> DataFrame:
    """Index entries (``probe`` false) and lookups of all words; of words shorter than a prefix and its pivots need, none."""
    names = [*_KEY, "last", "word", "n", "probe"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = order.get()
        for batch in rows:
            out: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prefix, pivots, last = signature(word, own)
                size = len(word)
                out += [(g, p, size, last, word, n, False) for g, p in prefix]
                out += [(g, p + move, size + longer, last, word, n, True) for g, p in pivots
                        for longer, move in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names) if out else _none()

    def _none() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names=names)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    schema = "gram long, place long, length long, last long, word string, n long, probe boolean"
    return words.where(F.char_length("word") >= PREFIX + GRAM - 1).select("word", "n").mapInArrow(run, schema)


def near_pairs(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """``a``, ``n_a``, ``b``, ``n_b`` of all words one edit apart, in both directions. Words have four letters or more."""
    order = Shared(words.sparkSession, gram_order(words), dict)
    entries = staged(_entries(words, order), "grams")
    index, probes = entries.where("not probe").drop("probe"), entries.where("probe").drop("probe")
    crowded = staged(index.groupBy(*_KEY).count().where(F.col("count") > split)
                     .select(*_KEY, F.ceil(F.col("count") / split).cast("int").alias("parts")), "crowded-grams")
    parts = F.coalesce("parts", F.lit(1))
    index = index.join(crowded, _KEY, "left").select(
        *_KEY, F.pmod(F.hash("word"), parts).alias("part"), F.col("last").alias("last_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    probes = probes.join(crowded, _KEY, "left").select(
        *_KEY, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("last").alias("last_a"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    met = probes.join(index, [*_KEY, "part"]).where(
        (F.col("last_a") <= F.col("last_b")) & (F.levenshtein("a", "b", EDITS) == EDITS))
    pairs = met.select("a", "n_a", "b", "n_b").distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"),
                                          F.col("n_a").alias("n_b"))).distinct()


def group_variants(words: DataFrame, factor: int = 5, split: int = SPLIT) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of counted words (``word``, ``n``; each word once)."""
    words = staged(words, "words")
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("near")))
    near = near_pairs(words, split).groupBy(F.col("a").alias("of")).agg(F.count("*").alias("n_near"), best.alias("best"))
    largest = -F.col("best.less")
    has_form = largest >= factor * F.col("n")
    formed = staged(words.join(near, words.word == near.of, "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best.near")).alias("form"),
        F.when(has_form, largest).alias("form_n")), "forms")
    roots = _roots(formed, factor)
    return formed.join(roots, formed.word == roots.of, "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(formed: DataFrame, factor: int) -> DataFrame:
    """``of`` and ``root`` of the words that have a form."""
    roots = staged(formed.where("form is not null").select(F.col("word").alias("of"), F.col("form").alias("root")), "roots")
    low, high = formed.agg(F.min("n"), F.max("n")).first()
    longest = math.log((high or 1) / (low or 1), factor) + 1 if factor > 1 else math.inf
    steps = 1
    while steps < longest:  # a chain of so many forms is followed to its end
        far = roots.select(F.col("of").alias("via"), F.col("root").alias("far"))
        roots = staged(roots.join(far, roots.root == far.via, "left").select("of", F.coalesce("far", "root").alias("root")), "roots")
        steps *= 2
    return roots


def spelling_variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5,
                      factor: int = 5, every: int | None = None, split: int = SPLIT) -> DataFrame:
    """The variants among the words of all texts that occur ``least_count`` times or more."""
    if least_length < PREFIX + GRAM - 1:
        raise ValueError(f"words of {PREFIX + GRAM - 1} letters or more are grouped")
    words = count_words(docs, key=key, text=text, least_length=least_length, every=every)
    return group_variants(words.where(F.col("n") >= least_count), factor, split)
