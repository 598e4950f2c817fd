"""Helpers that several operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from profilerank.session import written

THRESHOLD_PER_CENT = 75
SHINGLE_WORDS = 5
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS = 500  # of a batch or slice: whole texts are held several times over, on both sides of the pipe


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """The rows written to the shared folder and read back.

    Cuts the lineage: what is lost with an executor is read again from there.  The shuffle
    files behind it are of no use any more and go when the write is done.  ``batch_rows`` bounds the rows
    that go to a Python worker at once in this write; a smaller setting of the session stays.
    """
    if not batch_rows:
        return written(df, name)
    conf = df.sparkSession.conf
    before = conf.get(ARROW_ROWS)
    conf.set(ARROW_ROWS, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
    try:
        return written(df, name)
    finally:
        conf.set(ARROW_ROWS, before)


def in_slices(run: Callable, rows: int = TEXTS) -> Callable:
    """``run`` on slices of ``rows`` rows: what it makes of texts is held for so many at once, however long a batch is."""
    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))
    return sliced


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def version_of(text_col: str) -> Column:
    """Hash that tells rows of one id apart by their text; a null text counts as an empty one."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def owner() -> Column:
    """Name of a (doc, version), null ids too.  Texts that share one by chance get what either of them has."""
    return F.xxhash64("doc", "version").alias("of")


def text_bytes(value: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return (value or "").encode("utf-8", "surrogatepass")


def words_of(value: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() parts at exactly these six bytes."""
    return value.split()


def chunks_by_bytes(sizes, limit: int):
    """Half-open index ranges whose sizes add up to ``limit`` at most (or one row)."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


LETTER = re.compile(r"[^\W\d_]")
