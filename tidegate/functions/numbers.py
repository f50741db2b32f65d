"""Number helpers: correctly rounded decimals, hash remainders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions.binding import let

# 2^27 + 1 splits a double into two halves whose products are exact
_SPLITTER = 134217729.0


def round_exact(x: Column, digits: int) -> Column:
    """Round a double on its exact binary value, ties to the even digit.

    ``F.round`` works on the shortest decimal text of the double, which moves
    values that only look like ties.  Here the distance from the midpoint is
    computed without rounding error: both partial products are exact.
    """
    scale = float(10**digits)

    def pick(k: Column) -> Column:
        midpoint = k * 2.0 + 1.0
        return let(
            _SPLITTER * x - (_SPLITTER * x - x),
            lambda high: let(
                (high * (2.0 * scale) - midpoint) + (x - high) * (2.0 * scale),
                lambda gap: (
                    k + F.when((gap > 0) | ((gap == 0) & (k % 2.0 != 0)), F.lit(1.0)).otherwise(0.0)
                ) / scale,
            ),
        )

    return let(F.floor(x * scale).cast("double"), pick)


def fixed2(x: Column) -> Column:
    """A double as text with two decimals."""
    return F.format_string("%.2f", round_exact(x.cast("double"), 2))


def hex_remainder(hex_digits: Column, modulus: int, digits: int = 64) -> Column:
    """The remainder of a hexadecimal number too long for a bigint, a block of digits at a time."""
    block = 12
    if digits % block:
        hex_digits, digits = F.lpad(hex_digits, digits + block - digits % block, "0"), digits + block - digits % block
    rest = F.lit(0).cast("bigint")
    for start in range(1, digits, block):
        part = F.conv(F.substring(hex_digits, start, block), 16, 10).cast("bigint")
        rest = (rest * (16**block % modulus) + part) % modulus
    return rest
