"""Final score, score record, top N and order check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from profilerank import vocabulary as v
from profilerank.functions.numbers import fixed_text, round_exact
from profilerank.operators.positions import in_ranges, ranks
from profilerank.rules import Rules
from profilerank.session import written


def with_final_score(df: DataFrame, rules: Rules) -> DataFrame:
    """Calibrated score times anomaly and confidence factor.

    The cap of alternate records applies before the confidence factor; a
    record whose scoring stopped at a gate ends at 0.
    """
    score = F.col("calibrated") * F.col("anomaly_factor")
    score = F.when(F.col("route") == v.ROUTE_ALTERNATE, F.least(score, F.lit(rules.alternate_cap))).otherwise(score)
    score = score * (F.lit(0.80) + F.lit(0.20) * (F.col("confidence") / 100.0))
    return df.withColumn(
        "final_score", F.when(F.col("continue_scoring"), round_exact(score, 2)).otherwise(0.0))


def score_record(df: DataFrame) -> DataFrame:
    """The score record of every profile; parts that were not computed are 0 or empty."""
    scored = F.col("continue_scoring")
    when_scored = lambda c: F.when(scored, F.col(c)).otherwise(0.0)
    breakdown = F.struct("technical_fit", "engineering_culture", "hireability", "tech_sub_scores")
    return df.select(
        F.coalesce("candidate_id", F.lit("")).alias("candidate_id"),
        "passed_gates", "route", "flags", "final_score",
        when_scored("raw_fit").alias("raw_fit_score"),
        "cri",
        when_scored("shipping_velocity").alias("shipping_velocity"),
        when_scored("confidence").alias("confidence"),
        "alternate_pipeline",
        F.when(scored, breakdown).alias("breakdown"),
        F.when(scored, F.col("penalty_flags")).otherwise(F.array().cast("array<string>")).alias("penalty_flags"),
        F.when(scored, round_exact(F.col("anomaly_factor"), 3))
        .otherwise(F.col("anomaly_factor")).alias("honeypot_multiplier"),
    )


def with_keys(df: DataFrame, best: DataFrame, key: str = "candidate_id") -> DataFrame:
    """The rows whose key is in ``best``."""
    return df.join(best, F.col(key).eqNullSafe(F.col("_best")), "left_semi")


FEW = 1000  # rows of each task, of some 40 bytes, that go to the one task which merges a top n
SKETCH_ACCURACY = 10_000  # of the quantile: the cut is off by a share of 1 / this at most


def top_keys(scores: DataFrame, n: int, score: str, key: str) -> DataFrame:
    """(score, key) of the first ``n`` rows by (score descending, key) of a narrow table.

    A sketch of the scores, merged in a tree, gives a score that about n rows reach; the
    rest is filtered where it lies.  Only what is left is ordered, n rows of a task at
    most.  Reads ``scores`` a few times; for ``FEW`` rows at most the order alone does, in one pass.
    """
    if n > FEW and (total := scores.count()) > n:
        share = min(1.0, n / total + 2 / SKETCH_ACCURACY)
        cut = scores.agg(F.percentile_approx(score, F.lit(1.0 - share), SKETCH_ACCURACY)).first()[0]
        if cut is not None:
            near = scores.filter(F.col(score) >= cut)
            scores = near if near.count() >= n else scores
    return scores.orderBy(F.col(score).desc(), F.col(key).asc()).limit(n)


def top_n(df: DataFrame, n: int = 100, score: str = "final_score", key: str = "candidate_id",
          scores: DataFrame | None = None, rows: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The first ``n`` rows by (score descending, key), with their ``rank``.

    Only (score, key) is ordered, of the pairs of all rows (``scores``, if they are at hand; for more than
    ``FEW`` rows they are written to the shared folder first), and the rows of the best keys are then
    fetched by a semi-join, so that wide rows are neither sorted nor shuffled in full.
    ``rows`` may give the rows for a table of keys ``_best``, to put that join
    before the scoring.  Rows with equal key all take part; null
    scores come last.  The n rows of the result are numbered in one task.
    """
    if scores is None:
        scores = df.select(score, key) if n <= FEW else written(df.select(score, key), "scores")
    best = top_keys(scores, n, score, key).select(F.col(key).alias("_best")).distinct()
    order = [F.col(score).desc(), F.col(key).asc()]
    few = rows(best) if rows else with_keys(df, best, key)
    few = few.orderBy(*order).limit(n)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def order_violations(ranked: DataFrame, score: str = "final_score") -> DataFrame:
    """One row: number of ranks whose score is above that of the rank before."""
    before = F.lag(score).over(Window.orderBy("rank"))
    return (ranked.select("rank", score).withColumn("_before", before)
            .agg(F.count("*").alias("ranks"),
                 F.count_if(F.col(score) > F.col("_before")).alias("violations")))


def ranked_all(df: DataFrame, score: str = "final_score", key: str = "candidate_id") -> DataFrame:
    """Every row with its ``rank`` by (score descending, key), numbered within ranges of the score.

    The ranges are chosen from a sample, so the rows are written first and computed once.
    """
    return ranks(written(df, "scores"), [F.col(score).desc_nulls_last(), F.col(key).asc()])


def order_violations_of_all(ranked: DataFrame, score: str = "final_score") -> DataFrame:
    """As ``order_violations``, for any number of ranks: within ranges of them, and across their edges."""
    ranges = in_ranges(ranked.select("rank", score), ["rank"])
    before = F.lag(score).over(Window.partitionBy("_range").orderBy("rank", "_row"))
    edges = ranges.withColumn("_before", before).groupBy("_range").agg(
        F.count("*").alias("ranks"), F.count_if(F.col(score) > F.col("_before")).alias("inside"),
        F.min_by(score, F.struct("rank", "_row")).alias("first"), F.max_by(score, F.struct("rank", "_row")).alias("last"))
    ahead = F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("_range"))  # a row for each range
    return edges.withColumn("_ahead", ahead).agg(
        F.coalesce(F.sum("ranks"), F.lit(0)).alias("ranks"),
        (F.coalesce(F.sum("inside"), F.lit(0)) + F.count_if(F.col("first") > F.col("_ahead"))).alias("violations"))


def formatted_score(score: Column) -> Column:
    """A score of 0 to 100 as a fraction with four decimals."""
    return fixed_text(score / 100.0, 4)
