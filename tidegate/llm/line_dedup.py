"""Operator 5: removal of lines that are boilerplate on their site, with DataFrame functions only.

Lines are counted by host: on how many of the host's pages each occurs. A line that more than
``ratio`` of the pages of its host have, and at least ``least`` of them, is boilerplate there and
goes from every page of the host. Lines are compared without blanks at their ends.

A page sends each distinct line once, as 16 bytes of hash, and counts are combined before the
shuffle, so a line that stands on a third of all pages arrives as one row per task. A host has at
most (lines of a page / ratio) boilerplate lines. They are written as a table; pages then meet the
list of their host in a join for which Spark knows that table's size: it is broadcast only below
``spark.sql.autoBroadcastJoinThreshold``, and otherwise pages are shuffled by host, where Spark
splits hosts that are too large for a task.

With ``by_group`` copies and near copies on one host weigh as one page, in the count of a line and in that
of the host, so that a line's share says on how many different pages it is. Equal texts are counted once.
Then a page of which ``COPIED`` or more of its lines stand above the ratio is taken for a copy, and named by the
least of these lines: near copies differ in few lines, so nearly all of a group get one name and the group gets
few. Lines and hosts are then counted by names. A page that would keep no line but blank ones is left as it is:
it is a copy of others' lines and not a page around boilerplate. On a host of fewer than ``least`` pages or
names no line goes; where most pages are shared lines for the most part, too few go rather than too many.

Defined results: a null text stays null and an empty one empty; blank lines are kept; a page all
of whose lines go keeps an empty text (without ``by_group``); a null host is a host of its own; repeated rows are pages
of their own; an empty table gives an empty result; other columns are passed on under any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.plans.staging import staged

RATIO = 0.02
LEAST = 5
#: Share of a page's lines above the ratio from which on it counts as a copy.
COPIED = 0.7


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_key(line: Column) -> Column:
    """16 bytes for a line, null for a blank one."""
    trimmed = F.trim(line)
    return F.when(trimmed != "", F.unhex(F.md5(trimmed)))


def _line_keys(text: Column) -> Column:
    return F.array_distinct(F.transform(_lines(text), _line_key))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, least: int = LEAST,
                by_group: bool = False) -> DataFrame:
    """``host``, ``line`` (its key), pages with the line, pages of the host: lines above the ratio."""
    if not by_group:
        lines = pages.select(host.alias("host"), F.explode(_line_keys(text)).alias("line"))
        return _above(lines.where("line is not null"), pages.select(host.alias("host")), ratio, least)
    own = pages.select(host.alias("host"), F.md5(F.coalesce(text, F.lit(""))).alias("page"),
                       F.transform(F.array_compact(_line_keys(text)), F.hex).alias("lines"))
    texts = staged(own.dropDuplicates(["host", "page"]), "texts-of-hosts")
    shared = staged(_above(texts.select("host", F.explode("lines").alias("line")), texts.select("host"), ratio, least)
                    .groupBy(F.col("host").alias("of_host")).agg(F.collect_set("line").alias("shared")), "shared-lines")
    met = texts.join(shared, F.col("host").eqNullSafe(F.col("of_host")), "left").withColumn(
        "met", F.array_intersect("lines", F.coalesce("shared", F.array().cast("array<string>"))))
    copied = (F.size("met") > 0) & (F.size("met") >= COPIED * F.size("lines"))
    named = met.select("host", "lines", F.when(copied, F.array_min("met")).otherwise(F.col("page")).alias("name"))
    lines = named.select("host", "name", F.explode("lines").alias("line")).distinct().select("host", F.unhex("line").alias("line"))
    return _above(lines, named.select("host", "name").distinct().select("host"), ratio, least)


def _above(lines: DataFrame, pages: DataFrame, ratio: float, least: int) -> DataFrame:
    """``host``, ``line`` and both counts of the lines (a row for each page with the line) above the ratio of pages (a row each)."""
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= least)
    totals = pages.groupBy(F.col("host").alias("of_host")).agg(F.count("*").alias("host_pages"))
    return (counts.join(totals, F.col("host").eqNullSafe(F.col("of_host")))
            .where(F.col("n_pages") > ratio * F.col("host_pages")).select("host", "line", "n_pages", "host_pages"))


def drop_boilerplate(pages: DataFrame, host: Column, *, text: str = "text", ratio: float = RATIO, least: int = LEAST,
                     counts: tuple[str, str] | None = None, by_group: bool = False) -> DataFrame:
    """All columns, the text without the boilerplate lines of its host.

    ``counts`` names two more columns: the lines of the text, and how many of them went.
    """
    by_host = staged(boilerplate(pages, host, pages[text], ratio, least, by_group).groupBy("host")
                     .agg(F.collect_set("line").alias("lines")), "boilerplate")
    joined = pages.join(by_host, host.eqNullSafe(by_host["host"]), "left")
    lines = _lines(pages[text])
    kept = F.filter(lines, lambda line: ~F.coalesce(F.array_contains(by_host["lines"], _line_key(line)), F.lit(False)))
    if by_group:
        kept = F.when(F.exists(kept, lambda line: F.trim(line) != ""), kept).otherwise(lines)
    split = joined.select(*(pages[c] for c in pages.columns), lines.alias("__lines"), kept.alias("__kept"))
    out = [F.array_join("__kept", "\n").alias(c) if c == text else pages[c] for c in pages.columns]
    if counts:
        n_lines, n_kept = F.coalesce(F.size("__lines"), F.lit(0)), F.coalesce(F.size("__kept"), F.lit(0))
        n_lines, n_kept = F.greatest(n_lines, F.lit(0)), F.greatest(n_kept, F.lit(0))  # of a null text
        out += [n_lines.cast("long").alias(counts[0]), (n_lines - n_kept).cast("long").alias(counts[1])]
    return split.select(*out)
