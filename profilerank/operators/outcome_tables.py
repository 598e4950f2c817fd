"""Outcomes told by a verb of change near a metric, with verbs and metrics from a table.

A row is (kind, term, number): a ``verb``, a ``metric``, or a ``link`` that may stand for a verb
after a metric; with ``number`` a digit has to follow.  Every hit is a place in its text.  What
lies within reach of a verb or a metric is an interval of places, and intervals meet the
places of the other kind by a join on (text, stretch of places).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from profilerank import vocabulary as v
from profilerank.functions.outcomes import PERCENT_OR_TIMES
from profilerank.functions.text import bind
from profilerank.operators.term_tables import held_fragments
from profilerank.session import written

# What may stand between a verb and a metric
AFTER_VERB = r"(?U)^\s+[\w\-\s]{0,30}"
AFTER_METRIC = r"(?U)^[\w\-\s]{0,30}"
POINTS = r"(?U)\d\s*pp\b"
LINKS = (("went from", False), ("from ", True))
STRETCH = 64
OUTCOME_SCHEMA = "kind string, term string, number boolean"


def outcome_table(spark: SparkSession) -> DataFrame:
    """The verbs, metrics and links of the vocabulary as a table, ready to be edited."""
    rows = [("verb", t, False) for t in v.OUTCOME_VERBS] + [("metric", t, False) for t in v.OUTCOME_METRICS]
    return spark.createDataFrame(rows + [("link", t, number) for t, number in LINKS], OUTCOME_SCHEMA)


def _places(text: Column, term: Column) -> Column:
    """Where a term begins in a text, from 1, overlapping hits too."""
    pieces = F.split(text, F.concat(F.lit("(?=\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)")))

    def at(pieces):  # of the pieces that begin with the term
        found = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at"))
        return F.aggregate(pieces, found, lambda acc, piece: F.struct(
            (acc["next"] + F.length(piece)).alias("next"),
            F.when(F.startswith(piece, term), F.concat(acc["at"], F.array(acc["next"]))).otherwise(acc["at"]).alias("at")), lambda acc: acc["at"])

    return bind(pieces, at)


def change_pairs(df: DataFrame, key: list[str], text: str, table: DataFrame) -> DataFrame:
    """(key, first, second, distance): a verb with a metric after it within reach, or a metric with a verb or link after it.

    ``distance`` is the number of characters between the two.  Each pair of places is a row.
    """
    terms = table.withColumn("term", F.lower("term"))
    found = held_fragments(df, key, text, terms, ["kind", "term", "number"])

    def hit(one, at):
        end = at + F.length(one["term"])
        rest = F.substring(F.col("_text"), end, F.length("_text"))
        return F.struct(
            one["kind"].alias("kind"), one["term"].alias("term"), at.alias("at"), end.alias("end"),
            F.when(one["kind"] == "verb", F.length(F.regexp_extract(rest, AFTER_VERB, 0)))
            .when(one["kind"] == "metric", F.length(F.regexp_extract(rest, AFTER_METRIC, 0))).alias("reach"),
            (~one["number"] | rest.rlike(r"(?U)^\d")).alias("counts"))

    # inside the array of a text: no text is copied for a term or a place
    places = F.flatten(F.transform("_held", lambda one: F.transform(_places(F.col("_text"), one["term"]), lambda at: hit(one, at))))
    hits = written(found.select(*key, "_row", F.explode(places).alias("_hit")).select(*key, "_row", "_hit.*").filter("counts")
                   .drop("counts").distinct(), "hits")
    verbs = hits.filter("kind = 'verb' AND reach > 0").withColumn("begin", F.col("end") + 1)
    metrics = hits.filter("kind = 'metric'").withColumn("begin", F.col("end"))
    spans = verbs.union(metrics).withColumn("stretch", F.explode(F.sequence(
        F.floor(F.col("begin") / STRETCH), F.floor((F.col("end") + F.col("reach")) / STRETCH))))
    points = hits.select(F.col("_row").alias("_in"), F.col("kind").alias("other"), F.col("term").alias("second"),
                         F.col("at").alias("there"), F.floor(F.col("at") / STRETCH).alias("_stretch"))
    meets = ((F.col("_row") == F.col("_in")) & (F.col("stretch") == F.col("_stretch"))
             & F.col("there").between(F.col("begin"), F.col("end") + F.col("reach"))
             & ((F.col("kind") == "verb") == (F.col("other") == "metric")))
    return spans.join(points, meets).select(*key, F.col("term").alias("first"), "second", (F.col("there") - F.col("end")).alias("distance"))


def strict_outcomes(df: DataFrame, key: list[str], text: str, table: DataFrame) -> DataFrame:
    """(key, strict, pairs) of every key: a number, or a verb of change within reach of a metric it changes."""
    texts = written(df.select(*key, text), "texts")
    lowered = F.lower(F.col(text))
    numbers = F.coalesce(F.max(lowered.rlike(PERCENT_OR_TIMES) | lowered.rlike(POINTS)), F.lit(False))
    plain = texts.groupBy(*key).agg(numbers.alias("_numbers"))
    # a text costs far more than its bytes, and copies of one are dealt out as well
    pairs = change_pairs(texts.hint("rebalance"), key, text, table).groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.count("*").alias("_pairs"))
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return plain.join(pairs, on, "left").select(
        *key, (F.col("_numbers") | F.col("_pairs").isNotNull()).alias("strict"), F.coalesce("_pairs", F.lit(0)).alias("pairs"))
