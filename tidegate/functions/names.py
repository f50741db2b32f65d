"""Similarity of column names."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate import fixed_values as fixed
from tidegate.functions.numbers import fixed2


@dataclass(frozen=True)
class RenameHints:
    """Known synonyms and words that only decorate a name."""

    synonyms: dict[str, list[str]] = field(default_factory=lambda: dict(fixed.SYNONYMS))
    decorators: list[str] = field(default_factory=lambda: list(fixed.DECORATORS))

    def synonym_pairs(self) -> list[str]:
        """``a|b`` in both directions."""
        pairs = {(a.lower(), b.lower()) for a, bs in self.synonyms.items() for b in bs}
        return sorted({f"{a}|{b}" for a, b in pairs} | {f"{b}|{a}" for a, b in pairs})


def _ratio_udf():
    # defined here so that it is sent to executors by value
    def ratios(left: pa.Array, right: pa.Array) -> pa.Array:
        import pyarrow
        from difflib import SequenceMatcher

        kind = pyarrow.list_(pyarrow.float64())
        if left.null_count == len(left):  # the usual batch: no row needs a score
            return pyarrow.nulls(len(left), kind)
        known: dict[tuple[str, str], float] = {}
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist()):
            scores = None if a is None else []
            for pair in zip(a or (), b or ()):
                if pair not in known:
                    known[pair] = SequenceMatcher(None, pair[0].lower(), pair[1].lower()).ratio()
                scores.append(known[pair])
            out.append(scores)
        return pyarrow.array(out, kind)

    return F.arrow_udf(ratios, T.ArrayType(T.DoubleType()))


def similarity_ratios(left: Column, right: Column) -> Column:
    """Matching-block ratio (2·matches / total length) of two parallel arrays of names.

    Spark has no such function.  Rows with NULL arrays cost nothing in Python,
    and each distinct pair is computed once per batch.
    """
    return _ratio_udf()(left, right)


def tokens(name: Column) -> Column:
    """Distinct lower-case words of a column name, also split at camel case."""
    spaced = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")
    words = F.split(F.lower(spaced), r"[^A-Za-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def lexical(canonical: Column, source: Column, ratio: Column, canonical_words: Column,
            source_words: Column, hints: RenameHints) -> Column:
    """(score, evidence) of two names from their ratio and words."""
    cw, sw = canonical_words, source_words
    leftover = F.array_sort(F.array_union(F.array_except(cw, sw), F.array_except(sw, cw)))
    shared = F.size(F.array_intersect(cw, sw))
    both = (F.size(cw) > 0) & (F.size(sw) > 0)
    contained = both & ((shared == F.size(cw)) | (shared == F.size(sw)))
    plain_words = F.array(*[F.lit(w.lower()) for w in sorted(hints.decorators)]).cast("array<string>")
    containment = F.when(F.size(F.array_except(leftover, plain_words)) == 0, F.lit(0.9)).otherwise(0.8)
    jaccard = shared / F.size(F.array_union(cw, sw))
    overlap = both & ~contained & (shared > 0)
    pair = F.concat(F.lower(canonical), F.lit("|"), F.lower(source))
    synonym = pair.isin(hints.synonym_pairs()) if hints.synonyms else F.lit(False)
    score = F.least(
        F.greatest(
            ratio,
            F.when(contained, containment).when(overlap, F.lit(0.8) * jaccard).otherwise(0.0),
            F.when(synonym, F.lit(0.92)).otherwise(0.0),
        ),
        F.lit(1.0),
    )
    extra = F.when(F.size(leftover) > 0, F.array_join(leftover, ", ")).otherwise("none")
    evidence = F.filter(
        F.array(
            F.concat(F.lit("name similarity "), fixed2(ratio)),
            F.when(contained, F.concat(F.lit("token containment ("), extra, F.lit(" extra)")))
            .when(overlap, F.concat(F.lit("token overlap "), fixed2(jaccard))),
            F.when(synonym, F.lit("configured synonym")),
        ),
        lambda e: e.isNotNull(),
    )
    return F.struct(score.alias("score"), evidence.alias("evidence"))
