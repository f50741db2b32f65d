"""SQL and connect type verdicts as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate import fixed_values as fixed
from tidegate.functions.binding import let

# base name, optional (length[, scale]), optional UNSIGNED
_PATTERN = r"(?i)^\s*([a-z]+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)\s*)?(unsigned)?\s*$"


#: What a verdict may be; "identical" needs no rule.
VERDICTS = ("compatible", "requires_transformation", "risky", "destructive")


def _by_pair(rows: list[tuple[str, str, str]]) -> dict[tuple[str, str], str]:
    return {(old, new): verdict for old, new, verdict in rows}


@dataclass(frozen=True)
class TypeMatrix:
    """Verdicts for a contract type that now arrives as another type."""

    rules: dict[tuple[str, str], str] = field(default_factory=lambda: _by_pair(fixed.TYPE_RULES))
    connect_rules: dict[tuple[str, str], str] = field(
        default_factory=lambda: _by_pair(fixed.CONNECT_RULES))
    aliases: dict[str, str] = field(default_factory=lambda: dict(fixed.TYPE_ALIASES))
    families: dict[str, str] = field(default_factory=lambda: dict(fixed.CONNECT_FAMILIES))
    default: str = fixed.DEFAULT_VERDICT
    widening: str = fixed.LENGTH_WIDENING
    narrowing: str = fixed.LENGTH_NARROWING

    def __post_init__(self) -> None:
        object.__setattr__(self, "rules", {
            (self.base_name(a), self.base_name(b)): v for (a, b), v in self.rules.items()})

    def base_name(self, name: str) -> str:
        return self.aliases.get(name.upper(), name.upper())

    def parse(self, text: str | None) -> dict | None:
        """Parts of a SQL type that is known on the driver (contracts)."""
        m = re.match(_PATTERN, text or "")
        if not m:
            return None
        base, length, scale, unsigned = m.groups()
        return {
            "base": self.base_name(base),
            "length": int(length) if length else None,
            "scale": int(scale) if scale else None,
            "unsigned": bool(unsigned),
        }

    def parts(self, text: Column) -> Column:
        """Parts of a SQL type held in a column; NULL when it is not a plain type."""
        group = lambda n: F.regexp_extract(text, _PATTERN, n)
        base = F.upper(group(1))
        return F.when(
            text.rlike(_PATTERN),
            F.struct(
                F.coalesce(_lookup(self.aliases, base), base).alias("base"),
                group(2).try_cast("bigint").alias("length"),
                group(3).try_cast("bigint").alias("scale"),
                (group(4) != "").alias("unsigned"),
            ),
        )

    def compare_parts(self, expected: Column, actual: Column) -> Column:
        """Verdict for two parsed types."""
        e, a = expected, actual
        equal = ((e["base"] == a["base"]) & e["length"].eqNullSafe(a["length"])
                 & e["scale"].eqNullSafe(a["scale"]) & (e["unsigned"] == a["unsigned"]))
        zero = F.lit(0)
        same_base = (
            F.when(e["unsigned"] != a["unsigned"], "risky")
            .when(e["length"].isNull() | a["length"].isNull(),
                  F.when(e["scale"].eqNullSafe(a["scale"]), "identical").otherwise("risky"))
            .when((a["length"] >= e["length"])
                  & (F.coalesce(a["scale"], zero) >= F.coalesce(e["scale"], zero)), self.widening)
            .otherwise(self.narrowing)
        )
        rule = _lookup({f"{x}>{y}": v for (x, y), v in self.rules.items()},
                       F.concat(e["base"], F.lit(">"), a["base"]))
        return (
            F.when(e.isNull() | a.isNull(), self.default)
            .when(equal, "identical")
            .when(e["base"] == a["base"], same_base)
            .otherwise(F.coalesce(rule, F.lit(self.default)))
        )

    def verdict(self, expected: Column, actual: Column, expected_parts: Column | None = None) -> Column:
        """Verdict for a contract type (text) now arriving as another type (text).

        ``expected_parts`` skips parsing the contract side, which catalogues
        carry already.
        """
        if expected_parts is None:
            return let(self.parts(expected),
                       lambda e: let(self.parts(actual), lambda a: self.compare_parts(e, a)))
        return (
            F.when(expected_parts.isNotNull() & (expected == actual), "identical")
            .otherwise(let(self.parts(actual), lambda a: self.compare_parts(expected_parts, a)))
        )

    def connect_verdict(self, expected: Column, actual: Column) -> Column:
        rule = _lookup({f"{x}>{y}": v for (x, y), v in self.connect_rules.items()},
                       F.concat(expected, F.lit(">"), actual))
        return F.when(expected == actual, "identical").otherwise(
            F.coalesce(rule, F.lit(self.default)))

    def connect_family(self, connect_type: Column) -> Column:
        """JSON family of a connect type; NULL when unknown."""
        return _lookup(self.families, connect_type)

    def is_widening(self, expected: Column, actual: Column) -> Column:
        return self.verdict(expected, actual).isin("compatible", "identical")


def _lookup(table: dict[str, object], key: Column) -> Column:
    """A literal table, folded into the plan."""
    if not table:
        return F.lit(None).cast("string")
    literal = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    return F.try_element_at(literal, key)


def lookup(table: dict[str, object], key: Column) -> Column:
    return _lookup(table, key)
