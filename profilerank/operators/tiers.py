"""Tiers of a table by interval lookup: the row whose [lower, upper) holds a value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from profilerank.operators.positions import carried_forward

FEW = 256  # tiers up to which the sorted bounds stand in the plan; more are met in ranges of the value


def checked(tiers: DataFrame) -> DataFrame:
    """The tiers, if they neither overlap nor leave gaps; a null lower or upper bound is open."""
    after = Window.partitionBy(F.lit(0)).orderBy(F.col("lower").asc_nulls_first())
    bad = (tiers.select("lower", "upper", F.lead("lower").over(after).alias("_next"),
                        F.row_number().over(after).alias("_place"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("_all"))
           .filter((F.col("_place") < F.col("_all")) & ~F.coalesce(F.col("upper") == F.col("_next"), F.lit(False))
                   | (F.col("lower") >= F.col("upper"))))
    wrong = bad.limit(1).collect()
    if wrong:
        raise ValueError(f"tiers overlap or leave a gap at {wrong[0].upper!r} and {wrong[0]._next!r}")
    return tiers


def with_tier(df: DataFrame, value: str, tiers: DataFrame, result: str, name: str, few: int = FEW) -> DataFrame:
    """``df`` with the ``result`` of the tier whose [lower, upper) holds ``value``; null outside all, and for null values.

    Few tiers become a sorted array of the plan; a table of more meets the rows by ranges of the
    value, without a nested loop and whatever value a third of the rows has.
    """
    tiers = checked(tiers).select(F.col("lower").cast("double"), F.col("upper").cast("double"), F.col(result).alias("result"))
    rows = tiers.orderBy(F.col("lower").asc_nulls_first()).limit(few + 1).collect()
    x = F.col(value).cast("double")
    if 0 < len(rows) <= few:
        kind = tiers.schema["result"].dataType
        table = F.array(*[F.struct(F.lit(r.lower).cast("double").alias("lower"), F.lit(r.upper).cast("double").alias("upper"),
                                   F.lit(r.result).cast(kind).alias("result")) for r in rows])
        inside = F.filter(table, lambda t: (t["lower"].isNull() | (t["lower"] <= x)) & (t["upper"].isNull() | (x < t["upper"])))
        return df.withColumn(name, F.when(x.isNotNull(), F.try_element_at(inside, F.lit(1))["result"]))
    names = df.columns
    known = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], x.alias("_x"), F.lit(1).alias("_kind"))
    bounds = tiers.select(F.coalesce("lower", F.lit(float("-inf"))).alias("_x"), F.lit(0).alias("_kind"),
                          F.struct("upper", "result").alias("_tier"))
    both = known.unionByName(bounds, allowMissingColumns=True)
    found = carried_forward(both, [F.col("_x").asc_nulls_first(), "_kind"], "_tier", "_held").filter("_kind = 1")
    held = F.col("_x").isNotNull() & (F.col("_held.upper").isNull() | (F.col("_x") < F.col("_held.upper")))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.when(held, F.col("_held.result")).alias(name))
