"""Text clean-up: measurements, identifiers, blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate import fixed_values as fixed
from tidegate.functions.binding import let
from tidegate.functions.numbers import hex_remainder, round_exact
from tidegate.functions.sqltypes import lookup


def weight_to_kg(text: Column) -> Column:
    """``'1.5 pounds'`` as kilograms with three decimals; NULL when it cannot be read."""
    pattern = r"([\d.]+)\s*([A-Za-z]+)"
    plain = F.replace(text, F.lit(","), F.lit(""))
    amount = F.regexp_extract(plain, pattern, 1).try_cast("double")
    factor = lookup(fixed.UNIT_TO_KG, F.lower(F.regexp_extract(plain, pattern, 2)))
    return let(amount * factor, lambda kg: F.when(kg.isNotNull(), round_exact(kg, 3)))


def stable_quantity(row_id: Column) -> Column:
    """A stock level 0..199 that depends only on the row id."""
    return hex_remainder(F.sha2(row_id.cast("string"), 256), 200)


def collapse_blanks(text: Column, max_length: int | None = None) -> Column:
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.substring(clean, 1, max_length) if max_length else clean


def safe_name(*parts: Column) -> Column:
    """Parts joined by ``__`` as a lower-case identifier of ``[a-z0-9_]``."""
    joined = F.lower(F.concat_ws("__", *parts))
    return F.regexp_replace(F.regexp_replace(joined, r"[^a-z0-9_]+", "_"), r"^_+|_+$", "")


def shorten(text: Column, max_chars: int) -> Column:
    return F.when(F.length(text) > max_chars,
                  F.concat(F.substring(text, 1, max_chars), F.lit("...[truncated]"))).otherwise(text)
