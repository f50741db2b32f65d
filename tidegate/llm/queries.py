"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import (byte_bpe, chat, decontaminate, hard_negatives, language, line_dedup, neighbours, secrets, simhash,
                          spelling, token_counts, token_shards, url_filter)
from tidegate.llm.common import table
from tidegate.plans.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def joined_sha(texts: Column) -> Column:
    return F.sha2(F.array_join(texts, ","), 256)


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by the test items it repeats."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        joined_sha(F.col("items")).alias("items_sha256"), "contaminated")


@query
def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence with its slot in training order, read back from the written shards."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    blocks = token_shards.shards(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, end=50256, seed=7)
    read = token_shards.read_from(staged(blocks, "shards", "zstd"))
    return read.select("slot", F.col("key").alias("doc_id"), "part", F.size("ids").cast("long").alias("n_tokens"),
                       joined_sha(F.col("ids").cast("array<string>")).alias("ids_sha256"))


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    filters = language.train(docs.where(~language.held_out(docs.doc_id)))
    found = language.identify(docs, filters, keys=["doc_id"])
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by rules, else by the model."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(url_filter.labelled_table(spark)), URL_RULES, keys=["page_id"])


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, docs.source, counts=("n_lines", "n_dropped"))


@query
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one, among all."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets: the base kinds counted, all kinds listed."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), keys=["doc_id"])

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s.kind.isin(*kinds))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    return found.select("doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.BASE_KINDS),
                        F.sha2(listed(of(*secrets.BASE_KINDS)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one full of control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    added = spark.createDataFrame(hostile, turns.schema)
    return chat.read_back(chat.format_conversations(turns.unionByName(added)))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest document that its links reach."""
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), keys=["doc_id"])
    return groups.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, among all; every seventh one has its label moved on first."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.hard_negatives(rows, rows.vec_id % 50 == 0)


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text, and whether it exceeds 2,048 tokens."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, keys=["doc_id"])


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the texts with its near words, its form and the root that forms lead to."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), every=199)
