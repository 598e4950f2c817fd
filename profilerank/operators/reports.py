"""Summaries of the score table.  All combine on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from profilerank import vocabulary as v


def run_summary(scores: DataFrame, n: int) -> DataFrame:
    """One row: profiles scored, profiles passing, rows in the top n."""
    return scores.agg(
        F.count("*").alias("scored"),
        F.count_if(F.col("route") == v.ROUTE_PASS).alias("passing"),
        F.least(F.count("*"), F.lit(n).cast("bigint")).alias("ranked"))


def route_report(scores: DataFrame) -> DataFrame:
    """Per route and track: profiles, profiles above 0, best score, total in hundredths."""
    return scores.groupBy("route", "alternate_pipeline").agg(
        F.count("*").alias("profiles"),
        F.count_if(F.col("final_score") > 0).alias("scored"),
        F.max("final_score").alias("best"),
        F.sum(F.round(F.col("final_score") * 100).cast("bigint")).alias("hundredths"))


def score_histogram(scores: DataFrame, width: float = 5.0) -> DataFrame:
    """Number of profiles per route and score bin."""
    return (scores.groupBy("route", (F.floor(F.col("final_score") / width) * width).cast("double").alias("bin"))
            .agg(F.count("*").alias("profiles")))


def leading_rows(ranked: DataFrame, n: int = 20) -> DataFrame:
    """The first ranks with the numbers behind them, for a look at a run."""
    return ranked.filter(F.col("rank") <= n).select(
        "rank", "candidate_id", "final_score", "raw_fit_score", "cri", "route", "flags")
