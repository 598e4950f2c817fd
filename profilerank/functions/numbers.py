"""Rounding, number formatting and summing with exactly defined results."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _pattern(digits: int) -> Column:
    return F.lit("0" if digits == 0 else "0." + "0" * digits)


def fixed_text(value: Column, digits: int) -> Column:
    """``value`` with ``digits`` decimals, ties decided on the exact binary value.

    ``round``/``bround`` decide ties on the printed decimal (2.675 -> 2.68);
    ``format_number`` works on the double itself (2.675 is below the tie: 2.67).
    """
    return F.call_function("format_number", value.cast("double"), _pattern(digits))


def round_exact(value: Column, digits: int) -> Column:
    return fixed_text(value, digits).cast("double")


def compensated_sum(values: Column) -> Column:
    """Sum of an array of doubles with the rounding error carried along.

    The order of the additions then no longer decides the last bit, which
    matters for totals that are rounded afterwards.
    """
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("error"))

    def add(acc, x):
        total = acc["total"] + x
        lost = F.when(
            F.abs(acc["total"]) >= F.abs(x), (acc["total"] - total) + x
        ).otherwise((x - total) + acc["total"])
        return F.struct(total.alias("total"), (acc["error"] + lost).alias("error"))

    return F.aggregate(values, zero, add, lambda acc: acc["total"] + acc["error"])


def capped(value: Column, limit: float = 100.0) -> Column:
    return F.least(F.lit(limit), value)


def points(flag: Column, value: float) -> Column:
    """``value`` where the flag holds, else 0."""
    return F.when(flag, F.lit(value)).otherwise(F.lit(0 if isinstance(value, int) else 0.0))
