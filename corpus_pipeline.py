"""The corpus pipeline: five operators, one after the other.

Each stage works on what its predecessor kept, is written as Parquet to the shared folder
and read again.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from profilerank.llm import compression, decontaminate, minhash, packing, phrases
from profilerank.llm.common import stored, version_of
from profilerank.llm.queries import table, tokenizer_files


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones, does not reject."""
    model = compression.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return compression.not_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the smallest id's, of its texts that of the smallest hash.

    Rows without shingles and rows of a null id are in no class and stay.  Rows are told apart by
    id and text, so an id that stands on unlike texts is judged for each by itself; of
    rows with the same id and text one stays.
    """
    key = ["doc_id", "_version"]
    classes = stored(minhash.near_duplicates(docs, versions=True), "classes")
    dropped = classes.filter(~F.col("_stays")).select(key).distinct()
    rows = docs.withColumn("_version", version_of("text")).join(dropped, key, "left_anti")
    again = stored(classes.filter(F.col("_stays") & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
                   .groupBy(key).count().filter(F.col("count") > 1).select(key), "again")
    if not again.isEmpty():
        rows = (rows.join(again, key, "left_anti")
                .union(rows.join(again, key, "left_semi").dropDuplicates(key)))
    return rows.select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier; a text without any stays as it is.

    A document of which nothing remains goes.  ``n_chars`` follows the text.
    """
    cut = phrases.without_repeats(docs).filter(~((F.col("_n_removed") > 0) & (F.col("_n_removed") == F.col("_n_words"))))
    text = F.when(F.col("_n_removed") > 0, F.col("_kept")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_n_removed") > 0, F.length("_kept").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns(changed).select(docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=True)
    return found.filter(~F.col("_contaminated")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, **tokenizer_files())


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeated_passages),
    ("decontamination", benchmark_free),
    ("packing", packed),
]

#: Classifier, edit distance and tokens have no SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs
