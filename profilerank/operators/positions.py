"""Running totals, carried values, ranks and interval lookups over all rows of a table.

A window without a key puts every row into one task.  Here rows are dealt to ranges of the
order and written, each range is run through by itself, and what the ranges before it hold is
added: one row for each range, broadcast, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from profilerank.session import written

Order = Sequence[str | Column]


def _columns(names: Order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def in_ranges(df: DataFrame, order: Order, group: Sequence[str] = ()) -> DataFrame:
    """``df`` written in ranges of (group, order), with ``_range`` and ``_row``; equal rows may be split."""
    return written(df.withColumn("_row", F.monotonically_increasing_id())
                   .repartitionByRange(*_columns(group), *_columns(order), F.col("_row"))
                   .withColumn("_range", F.spark_partition_id()), "ranges")


def _same(left: str, right: str, names: Sequence[str]) -> Column:
    found = F.lit(True)
    for c in names:
        found = found & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return found


def running_total(df: DataFrame, order: Order, value: str | int, group: Sequence[str] = (),
                  name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` (a column, or 1 to count) over the earlier rows of the same group.

    Rows that are equal in ``order`` get one after the other in any order.  A group may hold
    all rows: it is split like any other.  Nulls are a group of their own and add nothing.
    """
    ranges = in_ranges(df.withColumn("_value", F.col(value) if isinstance(value, str) else F.lit(value).cast("long")),
                       order, group)
    inside = (Window.partitionBy("_range", *group).orderBy(*_columns(order), "_row")
              .rowsBetween(Window.unboundedPreceding, -1))
    totals = ranges.groupBy("_range", *group).agg(F.sum("_value").alias("_total"))
    # rows of this window: the ranges that a group goes through
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_carried", F.sum("_total").over(earlier)).filter(F.col("_carried").isNotNull())
    # a range goes on with one group at most
    return (ranges.withColumn("_inside", F.sum("_value").over(inside)).alias("l")
            .join(F.broadcast(carried.select("_range", *group, "_carried")).alias("r"), _same("l", "r", ["_range", *group]), "left")
            .select(*[F.col(f"l.`{c}`") for c in df.columns],
                    (F.coalesce("_inside", F.lit(0)) + F.coalesce("_carried", F.lit(0))).alias(name)))


def carried_forward(df: DataFrame, order: Order, value: str, name: str) -> DataFrame:
    """``df`` with the last ``value`` that is not null up to each row."""
    ranges = in_ranges(df, order)
    inside = Window.partitionBy("_range").orderBy(*_columns(order), "_row")
    run = ranges.withColumns({"_place": F.row_number().over(inside), "_inside": F.last(value, True).over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    ends = run.groupBy("_range").agg(F.max_by("_inside", "_place").alias("_end"))
    # rows of this window: the ranges
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", True).over(earlier)).select("_range", "_carried")
    return (run.join(F.broadcast(carried), "_range")
            .select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_inside", "_carried").alias(name)))


def ranks(df: DataFrame, order: Order, name: str = "rank") -> DataFrame:
    """``df`` with the rank 1, 2, ... of every row; equal rows get distinct ranks."""
    return running_total(df, order, 1, name=name).withColumn(name, F.col(name) + 1)
