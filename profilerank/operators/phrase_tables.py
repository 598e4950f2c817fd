"""Evidence phrases and topics as a priority table.

A row is (kind, priority, phrase, said, said_less): a ``phrase`` counts unless what stands right
before its first hit only serves to play the work down; a ``topic`` counts wherever one of its
needles occurs, and has other words where ownership is disclaimed.  Of what counts the
smallest priority is said.  A row that is added needs no code and no place in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from profilerank import vocabulary as v
from profilerank.operators.term_tables import few_rows, held_fragments
from profilerank.session import written

PHRASE_SCHEMA = "kind string, priority int, phrase string, said string, said_less string"


def phrase_table(spark: SparkSession) -> DataFrame:
    """The phrases and topics of the vocabulary as a table, ready to be edited."""
    rows = [("phrase", i, needle, said, said) for i, (needle, said) in enumerate(v.EVIDENCE_PHRASES)]
    rows += [("topic", i, needle, said, less) for i, (needles, said, less) in enumerate(v.EVIDENCE_TOPICS) for needle in needles]
    return spark.createDataFrame(rows, PHRASE_SCHEMA)


COLUMNS = ["kind", "priority", "term", "said", "said_less"]


def _firsts(text: str, held: str, markers: tuple[str, ...], window: int) -> tuple[Column, Column]:
    """The first phrase that counts and the first topic, by (priority, term), of the rows that a lower-case text holds; else null."""
    def played_down(term):
        at = F.instr(F.col(text), term)
        before = F.substring(F.col(text), F.greatest(F.lit(1), at - window), F.least(F.lit(window), at - 1))
        return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(before, m)) if markers else F.lit(False)

    first = lambda rows: F.array_min(F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in COLUMNS[1:]])))
    return (first(F.filter(held, lambda x: (x["kind"] == "phrase") & ~played_down(x["term"]))),
            first(F.filter(held, lambda x: x["kind"] == "topic")))


def claims(df: DataFrame, key: list[str], text: str, phrases: DataFrame, markers: tuple[str, ...] = v.COMPARATIVE_MARKERS,
           window: int = v.COMPARATIVE_WINDOW) -> DataFrame:
    """One row per key with a claim: (key, phrase, topic, topic_less), the first by priority of each kind, else null.

    Ties of priority go to the phrase that is first by code point.  Texts and phrases are compared in
    lower case.
    """
    found = held_fragments(df, key, text, phrases.withColumn("term", F.lower("phrase")), COLUMNS)
    phrase, topic = _firsts("_text", "_held", markers, window)
    place = lambda one: F.when(F.col(one).isNotNull(), F.struct(f"{one}.priority", f"{one}.term"))
    return found.select(*key, phrase.alias("_phrase"), topic.alias("_topic")).groupBy(*key).agg(
        F.min_by("_phrase.said", place("_phrase")).alias("phrase"),
        F.min_by("_topic.said", place("_topic")).alias("topic"), F.min_by("_topic.said_less", place("_topic")).alias("topic_less"))


def with_claims(df: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """Adds ``_claim``, ``_topic`` and ``_topic_less``: the claims of the text of every profile, null where it has none.

    A table of few rows goes to the texts, and the profiles stay where they are; for a larger one the texts of all rows
    are written once, and their claims join the profiles by (candidate_id, version of the text).
    """
    few = few_rows(phrases.withColumn("term", F.lower("phrase")), COLUMNS)
    if few is None:
        texts = written(df.select("candidate_id", F.xxhash64(text).alias("_version"), text).distinct(), "texts")
        found = claims(texts, ["candidate_id", "_version"], text, phrases).select(
            F.col("candidate_id").alias("_id"), F.col("_version").alias("_is"),
            F.col("phrase").alias("_claim"), F.col("topic").alias("_topic"), F.col("topic_less").alias("_topic_less"))
        return df.join(found, F.col("candidate_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_is")), "left").drop("_id", "_is")
    phrase, topic = _firsts("_lowered", "_held", v.COMPARATIVE_MARKERS, v.COMPARATIVE_WINDOW)
    return (df.withColumn("_lowered", F.lower(F.col(text)))
            .withColumn("_held", F.filter(few, lambda x: F.contains("_lowered", x["term"])))
            .withColumns({"_phrase": phrase, "_about": topic})
            .withColumns({"_claim": F.col("_phrase.said"), "_topic": F.col("_about.said"), "_topic_less": F.col("_about.said_less")})
            .drop("_lowered", "_held", "_phrase", "_about"))
