"""Operator 12: token counts, huge documents by overlap resynchronisation.

Counts are those of the tokenizer library for a whole text. A text longer than ``CHUNK`` characters is
encoded in chunks that overlap, with the place of every token. Where two chunks meet, a token that both
have at the same place is looked for; the left chunk counts up to it, the right one from there on. If
no such token stands in the overlap, the overlap is widened and the right chunk encoded again, at last
from the text's start; so a text without any boundary is encoded whole.

Why such a token is a safe boundary, for the vocabularies that ``splits`` accepts:

- Pair merging: a sequence of tokens is the encoding of a word if and only if each two neighbours are the
  encoding of what they spell. (The first merge over a boundary in the whole word would be one in its two
  neighbours alone.) All neighbours left of the common token are neighbours in the left chunk, all right of
  it in the right chunk.
- Words: the split pattern looks ahead three characters at most and never back, so a run of letters or
  signs ends at the same place in both chunks. Letters are common tokens only in words that start with a
  letter in both chunks, since ``'s`` and its like end within a run of letters.
- Normal form: the characters at both ends of the token start a sequence of their own (``_steady``).
- A control string that the left chunk's end cuts lies within ``edge`` characters of that end.

White space is a boundary by itself: it belongs to no word and to no control string, and composes with
nothing. Texts that are not huge are cut at blanks and line ends, and a worker remembers the counts of the
words between them for as long as they fit.

Defined results: a null or empty text has no bytes and no tokens; control strings inside texts are
tokens, as the library has them; repeated rows are counted each; an empty table gives an empty result;
other columns are not read and may have any names. Vocabularies of another build are asked for whole texts.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegate.llm.common import Shared, text_list

#: Characters of a chunk; longer texts are huge.
CHUNK = 1 << 16
#: Characters that two chunks share at first.
OVERLAP = 256
#: Words that a worker remembers, and their characters.
KNOWN_WORDS = 500_000
KNOWN_CHARACTERS = 8 << 20
#: Words that are encoded in one call, with blanks between them.
CALL = 500
#: Split patterns without looking back, whose matches hold no white space (fixed values of the vocabularies).
PATTERNS = ("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",)


def splits(spec: dict) -> bool:
    """Whether the boundaries of this module are proven for a tokenizer file."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    steps = cut.get("pretokenizers", [])
    normal = spec.get("normalizer") or {}
    normal = normal.get("normalizers", [normal] if normal else [])
    blank = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    return (model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
            and all(n == blank or n == {"type": n["type"]} and n["type"] in ("NFC", "Lowercase") for n in normal)
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"].get("Regex") in PATTERNS and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
            and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]]
                        for t in spec["added_tokens"]))


@cache
def _joining() -> frozenset[str]:
    """Characters that some character composes with on its left."""
    found = [chr(p) for p in [*range(0x1161, 0x1176), *range(0x11A7, 0x11C3)]]  # of Hangul syllables
    for point in range(0x110000):
        parts = unicodedata.decomposition(chr(point))
        if parts and not parts.startswith("<"):
            found += [chr(int(p, 16)) for p in parts.split()[1:]]
    return frozenset(found)


def _steady(char: str) -> bool:
    """Whether normal form never moves or joins anything over the place before this character."""
    return char < "\x80" or all(not unicodedata.combining(c) and c not in _joining() for c in unicodedata.normalize("NFD", char))


@dataclass
class Piece:
    """The encoding of ``text[start:end]``."""

    start: int
    end: int
    ids: list[int]
    places: list[tuple[int, int]]
    words: list[int | None]

    def alone(self, i: int) -> bool:
        """Whether no other token has part of the characters of token i."""
        low, high = self.places[i]
        return (low < high and (i == 0 or self.places[i - 1][1] <= low)
                and (i + 1 == len(self.ids) or self.places[i + 1][0] >= high))

    def word_start(self, i: int) -> int:
        """The place in the text where the word of token i starts."""
        while i and self.words[i] is not None and self.words[i - 1] == self.words[i]:
            i -= 1
        return self.start + self.places[i][0]


class TokenCounter:
    """Counts tokens of texts as the library does."""

    def __init__(self, spec: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        read = json.loads(spec)
        self.chunk, self.overlap, self.splits = chunk, overlap, splits(read)
        self.edge = max([len(t["content"]) for t in read["added_tokens"]], default=0) + 8
        self._suffix = read["model"].get("end_of_word_suffix") or ""
        self._added = {t["id"] for t in read["added_tokens"]}
        self._known: dict[str, int] = {}
        self._characters = 0
        #: Chunks that were encoded again because no common token was found.
        self.widened = 0

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(self.tokenizer.encode(t, add_special_tokens=False)) for t in texts]
        short = iter(self._by_words([t for t in texts if len(t) <= self.chunk]))
        return [next(short) if len(t) <= self.chunk else self.count_huge(t) for t in texts]

    def _by_words(self, texts: list[str]) -> list[int]:
        if len(self._known) > KNOWN_WORDS or self._characters > KNOWN_CHARACTERS:
            self._known, self._characters = {}, 0
        known, words = self._known, [t.replace("\n", " ").split(" ") for t in texts]
        new = list({w for own in words for w in own if w not in known})
        for i in range(0, len(new), CALL):
            part = new[i : i + CALL]
            starts = [low for low, _ in self.tokenizer.encode(" ".join(part), add_special_tokens=False).offsets]
            ends = np.cumsum([len(w) + 1 for w in part])
            known.update(zip(part, np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(part)).tolist()))
        self._characters += sum(map(len, new))
        return [sum(map(known.__getitem__, own)) for own in words]

    def _encode(self, text: str, start: int, end: int) -> Piece:
        made = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        return Piece(start, end, made.ids, made.offsets, made.word_ids)

    def count_huge(self, text: str) -> int:
        """Tokens of a text of any length, from overlapping chunks."""
        left, first, total = self._encode(text, 0, self.chunk), 0, 0
        while left.end < len(text):
            overlap, length = self.overlap, left.end - left.start
            while overlap < length:
                right = self._encode(text, left.end - overlap, min(left.end - overlap + max(self.chunk, 2 * overlap), len(text)))
                if (at := self._common(text, left, right, first)) is not None:
                    total += at[0] + 1 - first
                    left, first = right, at[1] + 1
                    break
                self.widened += 1
                overlap = 2 * overlap + 37  # odd, so that runs of one character come into step
            else:
                left, first, total = self._encode(text, 0, min(2 * left.end, len(text))), 0, 0
        return total + len(left.ids) - first

    def _common(self, text: str, left: Piece, right: Piece, first: int) -> tuple[int, int] | None:
        """The last token that both pieces have at the same place and behind which the right one may go on."""
        at = {}
        for j, (low, high) in enumerate(right.places):
            if right.start + high > left.end - self.edge:
                break
            at[right.start + low, right.start + high] = j
        for i in range(len(left.ids) - 1, first - 1, -1):
            low, high = left.start + left.places[i][0], left.start + left.places[i][1]
            if low <= right.start:
                return None
            j = at.get((low, high))
            if (j is not None and left.ids[i] == right.ids[j] and left.alone(i) and right.alone(j)
                    and _steady(text[low]) and _steady(text[high]) and self._ends_alike(text, left, i, right, j)):
                return i, j
        return None

    def _ends_alike(self, text: str, left: Piece, i: int, right: Piece, j: int) -> bool:
        """Whether the word of a common token ends at one place in both pieces."""
        own = left.ids[i]
        if own in self._added or self._suffix and self.tokenizer.id_to_token(own).endswith(self._suffix):
            return True
        if not text[left.start + left.places[i][0]].isalpha():
            return True
        return text[left.word_start(i)].isalpha() and text[right.word_start(j)].isalpha()


def count_tokens(docs: DataFrame, path: str, limit: int, *, keys: list[str], text: str = "text") -> DataFrame:
    """Key columns, ``n_bytes``, ``n_tokens`` and ``over_limit``. One scan, no shuffle.

    The vocabulary is read on the driver and sent to the executors (its file, some 2 MB).
    """
    with open(path, encoding="utf-8") as file:
        shared = Shared(docs.sparkSession, file.read(), TokenCounter)
    n = len(keys)
    schema = docs.select(*(docs[k] for k in keys)).schema.add("n_bytes", "long").add("n_tokens", "long")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.get()
        for batch in rows:
            counts = counter.count(text_list(batch.column(n + 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(counts, pa.int64())], names=schema.names)

    size = F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long")
    counted = docs.select(*(docs[k] for k in keys), size.alias("__bytes"), docs[text].alias("__text")).mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
