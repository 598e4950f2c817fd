"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

RANKED_COLUMNS = ("candidate_id", "rank", "score", "reasoning")


def write_ranked(ranked: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the top N as one CSV file: header, minimal quoting, UTF-8, CRLF.

    ``ranked`` holds N rows by construction, so one file is safe; nothing else
    in this package goes through a single task.
    """
    (ranked.select(*RANKED_COLUMNS)
     .coalesce(1).sortWithinPartitions("rank")
     .write.mode(mode)
     .option("header", True).option("escape", '"').option("encoding", "UTF-8")
     .option("emptyValue", "").option("lineSep", "\r\n")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_scores(scores: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the score record of every profile, laid out by route.

    Every task writes its own rows; no shuffle takes place, so a route that
    holds most of the rows is written by all tasks alike.
    """
    scores.write.mode(mode).partitionBy("route").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("route", F.col("route").cast("string"))
