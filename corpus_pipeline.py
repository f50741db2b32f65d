"""A corpus pipeline: five operators in turn, each over all that its predecessor kept.

Stages take and return the columns of ``documents``; each one's output is written to the shared
folder and read by the next. All but the last filter or rewrite documents:

1. language: documents without letters, or of which under half of the trigrams belong to their
   predicted language, go. The filters learn from the documents whose ids are not held out.
2. line_dedup: lines that are boilerplate on their source go from the text; ``n_chars`` follows. Copies
   and near copies weigh as one page, so a group of them is left whole for the next stage.
3. near_duplicates: of each group of near copies the document with the smallest id stays.
4. decontaminate: documents that repeat benchmark items for a word in twenty or more go.
5. byte_bpe: the token ids of each text, as digests with their round trip.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import byte_bpe, decontaminate, language, line_dedup, simhash
from tidegate.llm.common import table
from tidegate.plans.staging import staged

LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    filters = language.train(docs.where(~language.held_out(docs.doc_id)))
    return language.drop_undetermined(docs, filters, LEAST_SCORE)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lines = line_dedup.drop_boilerplate(docs, docs.source, by_group=True)
    return lines.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", known_language),
    ("line_dedup", without_boilerplate),
    ("near_duplicates", without_near_duplicates),
    ("decontaminate", without_benchmark),
    ("byte_bpe", tokens),
]
#: SQL has neither the hash of the fingerprints nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
