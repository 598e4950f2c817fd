"""Title rules from a table, matched once for every distinct title.

A row is (rule, priority, term, value): a title that holds the term gets the value under the
rule's name; of several terms the smallest priority counts.  Titles repeat much more
often than they differ, so the work grows with the distinct ones, and codes go back by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from profilerank import vocabulary as v
from profilerank.operators.term_tables import found_fragments
from profilerank.rules import Rules
from profilerank.session import written

TITLE_SCHEMA = "rule string, priority int, term string, value int"
FEW_TITLES = 100_000  # distinct titles whose codes are broadcast; more are joined by a shuffle


def title_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """The tiers and title tests of the vocabulary as a table, ready to be edited."""
    rows = [("tier", i, term, level) for i, (level, terms) in enumerate(v.TITLE_TIERS) for term in terms]
    for rule, terms in (("contradicts", rules.terms.contradicting_titles), ("vision_only", rules.terms.vision_titles),
                        ("relevant", rules.terms.relevant_titles)):
        rows += [(rule, 0, term, 1) for term in terms.fragments]
    return spark.createDataFrame(rows, TITLE_SCHEMA)


def title_codes(df: DataFrame, title: str, table: DataFrame) -> DataFrame:
    """(title, codes): of every distinct title, in lower case, the values by rule; titles without a hit have no row."""
    titles = written(df.select(F.lower(title).alias("title")).filter(F.col("title") != "").distinct(), "titles")
    terms = table.withColumn("term", F.lower("term"))
    found = found_fragments(titles, ["title"], "title", terms.select("term")).join(terms, "term")
    first = found.groupBy("title", "rule").agg(F.min_by("value", F.struct("priority", "term")).alias("value"))
    return first.groupBy("title").agg(F.map_from_entries(F.collect_list(F.struct("rule", "value"))).alias("codes"))


def with_title_codes(df: DataFrame, title: str, table: DataFrame, name: str = "codes") -> DataFrame:
    """``df`` with the codes of each row's title; an empty map where no rule applies, and for null titles."""
    codes = written(title_codes(df, title, table), "codes").select(F.col("title").alias("_title"), F.col("codes").alias("_codes"))
    few = codes.limit(FEW_TITLES + 1).count() <= FEW_TITLES
    names = df.columns
    joined = df.join(F.broadcast(codes) if few else codes, F.lower(title) == F.col("_title"), "left")
    empty = F.create_map().cast("map<string,int>")
    return joined.select(*names, F.coalesce("_codes", empty).alias(name))


def code(codes: str, rule: str, default: int = 0) -> Column:
    return F.coalesce(F.try_element_at(F.col(codes), F.lit(rule)), F.lit(default))
