"""Scorecards as a weight table: every scorecard weighs every row, and keeps its own top N."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from profilerank.session import written

DIGITS = 10_000  # scores and weights count in ten-thousandths, so that sums are exact
PART_ROWS = 100_000  # rows of a task
BLOCK = 20_000  # scorecards of a task
PASS_CARDS = 512  # scorecards, and rows, whose sums a task holds at once
PASS_ROWS = 2048
FIRST_ROWS = 64  # of a first pass, in which most rows are candidates


def _cards(weights: DataFrame, scores: list[str]) -> DataFrame:
    """(scorecard, _w0, _w1, ...): the weights of a scorecard in the order of ``scores``; missing ones are 0."""
    unknown = weights.filter(~F.col("score").isin(scores)).select("score").limit(1).collect()
    if unknown:
        raise ValueError(f"no score named {unknown[0][0]!r}")
    points = F.round(F.col("weight") * DIGITS).cast("long")
    each = [F.coalesce(F.sum(F.when(F.col("score") == name, points)), F.lit(0)).alias(f"_w{i}") for i, name in enumerate(scores)]
    return weights.groupBy("scorecard").agg(*each)


def _numbers(table: pa.Table, prefix: str, n: int) -> np.ndarray:
    return np.column_stack([table.column(f"{prefix}{i}").to_numpy() for i in range(n)])


def best_places(values: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scorecard, row, points) of the first ``n`` rows of every scorecard by (points descending, place of the row).

    Sums are whole numbers: in doubles where none can reach 2 ** 53, else in 64 bits.
    """
    most = (np.abs(weights).max(axis=0, initial=0).astype(object) * np.abs(values).max(axis=0, initial=0).astype(object)).sum()
    if most >= 2 ** 63:
        raise OverflowError("the points of a scorecard do not fit 64 bits")
    kind = np.float64 if most < 2 ** 53 else np.int64
    if not len(values) or not len(weights):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    values, weights = values.astype(kind), weights.astype(kind)
    lowest = -np.inf if kind is np.float64 else np.iinfo(kind).min
    found = []
    for first in range(0, len(weights), PASS_CARDS):
        tile = weights[first:first + PASS_CARDS]
        card, row, points = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind)
        low = np.full(len(tile), lowest)  # points of the last of n rows; a later row must have more
        start, step = 0, FIRST_ROWS
        while start < len(values):
            sums = tile @ values[start:start + step].T
            c, r = np.nonzero(sums > low[:, None])
            if len(c):
                card, row = np.concatenate([card, c]), np.concatenate([row, r + start])
                points = np.concatenate([points, sums[c, r]])
                order = np.lexsort((row, -points, card))
                card, row, points = card[order], row[order], points[order]
                place = np.arange(len(card)) - np.searchsorted(card, card)
                kept = place < n
                card, row, points, last = card[kept], row[kept], points[kept], place[kept] == n - 1
                low[card[last]] = points[last]
            start, step = start + step, min(4 * step, PASS_ROWS)
        found.append((card + first, row, points.astype(np.int64)))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _dealt(df: DataFrame, dealt: str, parts: int, copied: str, copies: int, tasks: int) -> DataFrame:
    """Every row in one of the ``parts``, and there in each of the ``copies``."""
    return (df.withColumn(dealt, F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int"))
            .withColumn(copied, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
            .repartition(tasks, "_part", "_block"))


def top_by_scorecard(df: DataFrame, key: str, scores: list[str], weights: DataFrame, n: int) -> DataFrame:
    """(scorecard, rank, key, points, total): the first ``n`` rows of every scorecard by (total descending, key).

    ``weights`` has (scorecard, score, weight) and any number of rows; repeated ones add up.  ``total`` is the sum of
    score * weight / 100.  Rows and scorecards are written once; every part of the rows meets every block of the
    scorecards in one task, which keeps n rows of a scorecard and shuffles nothing else.
    """
    values = [F.round(F.coalesce(F.col(name), F.lit(0.0)) * DIGITS).cast("long").alias(f"_v{i}") for i, name in enumerate(scores)]
    rows = written(df.select(F.col(key), *values), "values")
    cards = written(_cards(weights, scores), "cards")
    parts, blocks = max(1, -(-rows.count() // PART_ROWS)), max(1, -(-cards.count() // BLOCK))
    tasks = parts * blocks

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        # null keys are first, as in Spark's order
        left = left.take(pc.sort_indices(left, sort_keys=[(key, "ascending")], null_placement="at_start"))
        card, row, points = best_places(_numbers(left, "_v", len(scores)), _numbers(right, "_w", len(scores)), n)
        return pa.table({"scorecard": right.column("scorecard").take(card), key: left.column(key).take(row), "points": points})

    kinds = [cards.schema["scorecard"], rows.schema[key]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", points long"
    left = _dealt(rows, "_part", parts, "_block", blocks, tasks).groupBy("_part", "_block")
    right = _dealt(cards, "_block", blocks, "_part", parts, tasks).groupBy("_part", "_block")
    order = Window.partitionBy("scorecard").orderBy(F.col("points").desc(), key)
    found = (left.cogroup(right).applyInArrow(best, schema)
             .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n))
    return found.select("scorecard", "rank", key, "points", (F.col("points") / (DIGITS * DIGITS * 100.0)).alias("total"))
