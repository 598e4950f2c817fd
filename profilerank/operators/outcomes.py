"""Quantified outcomes as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from profilerank.functions.outcomes import best_outcome, outcomes


def extract_outcomes(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """Every percentage outcome of a text: (key, pos, verb, metric, amount, value)."""
    return (df.select(*key, outcomes(F.col(text)).alias("_found"))
            .select(*key, F.posexplode("_found").alias("pos", "_one"))
            .select(*key, "pos", "_one.*"))


def best_outcomes(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """The largest outcome per row; rows without one are left out."""
    best = F.array(best_outcome(outcomes(F.col(text))))
    return df.select(*key, F.inline(F.filter(best, lambda one: one.isNotNull())))
