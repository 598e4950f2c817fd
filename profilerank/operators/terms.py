"""Term matching over any table with a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from profilerank.functions.text import any_term, count_occurrences, count_terms, hits_sql, once, words_sql
from profilerank.vocabulary import TermList


def _with_forms(df: DataFrame, text: str, terms: TermList) -> DataFrame:
    return (df.withColumn("_raw", F.lower(text))
            .withColumn("_words", F.expr(words_sql("_raw", terms.words))))


def with_term_features(df: DataFrame, text: str, terms: TermList, prefix: str = "term") -> DataFrame:
    """Per row: does any term occur, how many distinct ones, how many times."""
    return _with_forms(df, text, terms).withColumns({
        f"{prefix}_any": any_term(terms, "_raw", "_words"),
        f"{prefix}_count": count_terms(terms, "_raw", "_words"),
        f"{prefix}_occurrences": count_occurrences(terms, "_raw", "_words"),
    }).drop("_raw", "_words")


def term_hits(df: DataFrame, key: list[str], text: str, terms: TermList) -> DataFrame:
    """One row per (key, term, mode) that occurs, with its number of occurrences.

    The terms are literals of the plan: every text is matched where it lies,
    only hits leave the row, and neither a join nor a shuffle takes place.
    """
    return (_with_forms(df.select(*key, text), text, terms)
            .select(*key, F.inline(once("_raw", hits_sql(terms, "x", "_words")))))
