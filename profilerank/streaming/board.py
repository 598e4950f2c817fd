"""Streaming: the batch scoring on a stream, and a running top N.

Scoring looks at one record at a time, so the stream needs no state and no
watermark.  The running top N is the only thing that has to be remembered; it
is kept as a small table with one version per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from profilerank.operators.explanation import with_reasoning
from profilerank.operators.ranking import score_record, top_n, with_keys
from profilerank.plans.scoring import scored
from profilerank.rules import Rules
from profilerank.session import written
from profilerank.sources import normalise
from profilerank.streaming.versions import Versions

BOARD_COLUMNS = ("candidate_id", "final_score", "route", "cri", "reasoning")


def score_stream(raw: DataFrame, rules: Rules | None = None, signals_field: str = "signals") -> DataFrame:
    """All scoring columns for a stream of raw profiles."""
    rules = rules or Rules()
    return scored(normalise(raw.filter(F.col("candidate_id").isNotNull()), signals_field), rules)


def start_scores(raw: DataFrame, path: str, checkpoint: str, rules: Rules | None = None,
                 signals_field: str = "signals", **trigger) -> StreamingQuery:
    """Append the score record of every arriving profile to a Parquet table.

    The file sink commits each micro-batch once, so a restart repeats nothing.
    """
    records = score_record(score_stream(raw, rules, signals_field))
    return (records.writeStream.format("parquet").partitionBy("route")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def update_board(batch: DataFrame, number: int, path: str, n: int, rules: Rules,
                 rows: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write version ``number`` of the board: the best of the version before and the scored batch, with ``rows`` of ``top_n``.

    A checkpoint's first batch opens a new run, whatever board lies there already; later
    ones go on with the newest run.  A micro-batch that runs again after a failure
    overwrites its own version with the same rows.  The last few versions are kept.
    """
    table = Versions(batch.sparkSession, path)
    run = table.newest_run() + (number == 0)
    # the n rows are written: the top of them and the board reads its rows twice
    new = written(batch.transform(top_n, n, rows=rows).transform(with_reasoning, rules).select(*BOARD_COLUMNS), "batch")
    if number > 0:
        new = table.read(run, number - 1).select(*BOARD_COLUMNS).unionByName(new)
    table.write(top_n(new, n).select(*BOARD_COLUMNS, "rank"), run, number)


RESERVE = 4  # times n: rows that stand by when others on the board go down
_BOARD = ", ".join(f"{c} {kind}" for c, kind in zip(BOARD_COLUMNS, ("string", "double", "string", "double", "string")))
_FLOOR = "floor_score double, floor_id string"


def newest_records(raw: DataFrame, last_by: list[str], rules: Rules | None = None,
                   signals_field: str = "signals") -> DataFrame:
    """A stream of (id, newest board columns) of the ids that arrive: one row of state for each id.

    The newest record of an id is the one that is last by ``last_by``, columns of the source;
    of equal ones that with the largest hash.  Meant for update mode.
    """
    rules = rules or Rules()
    columns = normalise(raw.filter(F.col("candidate_id").isNotNull()), signals_field, keep=tuple(last_by))
    records = scored(columns, rules).transform(with_reasoning, rules)
    kept = F.struct(*BOARD_COLUMNS)
    place = F.struct(*[F.col(c.split(".")[-1]) for c in last_by], F.xxhash64(*BOARD_COLUMNS))
    return (records.groupBy("candidate_id").agg(F.max_by(kept, place).alias("newest")).select("newest.*"))


def _above(floor) -> Column:
    """Whether a row stands at or above the last row of a full reserve."""
    if floor is None or floor.floor_score is None:
        return F.lit(True)
    score = F.col("final_score")
    return (score > floor.floor_score) | (score == floor.floor_score) & (F.col("candidate_id") <= floor.floor_id)


def _newest_of_log(spark: SparkSession, log: str, run: int, number: int) -> DataFrame:
    """The newest row of every id in the batches of a run; what a batch says of an id replaces what the ones before said."""
    schema = f"{_BOARD}, run long, batch long"
    rows = spark.read.schema(schema).option("basePath", log).parquet(f"{log}/run={run}").filter(F.col("batch") <= number)
    return (rows.groupBy("candidate_id").agg(F.max_by(F.struct(*BOARD_COLUMNS), "batch").alias("newest")).select("newest.*"))


def update_newest_board(updates: DataFrame, number: int, path: str, n: int) -> None:
    """Bring the board to the newest records of the ids in ``updates``; each id stands on it once.

    An id whose newest score is lower may leave the board, and one that never stood there has to
    take its place.  So the best ``RESERVE`` * n rows are kept, and the place (score, id) under
    which others may lie outside.  Only when so many went down that less than n are left is
    the log of all updates read again.  A batch that runs again overwrites its own part of the log and its own
    version; a checkpoint's first batch opens a new run.
    """
    spark = updates.sparkSession
    table, log = Versions(spark, f"{path}/reserve"), f"{path}/log"
    run = table.newest_run() + (number == 0)
    part = f"{log}/run={run}/batch={number}"
    updates.select(*BOARD_COLUMNS).write.mode("overwrite").parquet(part)
    new = spark.read.schema(_BOARD).parquet(part)
    floor = None
    if number > 0:
        before = table.read(run, number - 1)
        floor = before.select("floor_score", "floor_id").first()
        new = (before.select(*BOARD_COLUMNS).join(new.select("candidate_id"), "candidate_id", "left_anti")
               .unionByName(new.filter(_above(floor))))
        if floor is not None and floor.floor_score is not None and new.limit(n).count() < n:
            new, floor = _newest_of_log(spark, log, run, number), None
    best = top_n(new, RESERVE * n)
    rows = best.select(*BOARD_COLUMNS, "rank").persist()
    last = rows.filter(F.col("rank") == RESERVE * n).first()
    edge = (last.final_score, last.candidate_id) if last else tuple(floor) if floor else (None, None)
    table.write(rows.select("*", F.lit(edge[0]).cast("double").alias("floor_score"), F.lit(edge[1]).cast("string").alias("floor_id")), run, number)
    rows.unpersist()


def start_newest_board(raw: DataFrame, path: str, checkpoint: str, last_by: list[str], n: int = 100,
                       rules: Rules | None = None, signals_field: str = "signals", **trigger) -> StreamingQuery:
    """Keep the explained top ``n`` of the newest record of every id seen so far below ``path``.

    State is one row for each id, without a watermark: an id may change at any time.  For more ids than
    fit in memory choose the RocksDB state store in the session.
    """
    return (newest_records(raw, last_by, rules, signals_field).writeStream.outputMode("update")
            .foreachBatch(lambda batch, number: update_newest_board(batch, number, path, n))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_newest_board(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """The first ``n`` ranks of the latest version."""
    return Versions(spark, f"{path}/reserve").latest().filter(F.col("rank") <= n).select(*BOARD_COLUMNS, "rank")


def start_board(raw: DataFrame, path: str, checkpoint: str, n: int = 100, rules: Rules | None = None,
                signals_field: str = "signals", **trigger) -> StreamingQuery:
    """Keep the explained top ``n`` of all profiles seen so far below ``path``.

    A micro-batch is scored where its top is taken: what a stream hands over is computed with all its columns each time it
    is read.  So all profiles are scored once, for their final score alone, and the n best again, for the rest.
    """
    rules = rules or Rules()

    def update(batch: DataFrame, number: int) -> None:
        scored_rows = lambda profiles: score_stream(profiles, rules, signals_field)
        update_board(scored_rows(batch), number, path, n, rules, rows=lambda best: scored_rows(with_keys(batch, best)))

    return (raw.writeStream.foreachBatch(update)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_board(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of the newest run; no other version is read."""
    return Versions(spark, path).latest()
