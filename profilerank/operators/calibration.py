"""Penalties and bonuses on the capped score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from profilerank import vocabulary as v
from profilerank.functions.numbers import fixed_text, round_exact
from profilerank.rules import Rules


def with_calibration(df: DataFrame, rules: Rules) -> DataFrame:
    """Multiply the factors that apply, in a fixed order, and name them.

    Short tenure is not held against a record that already pays for chasing
    titles.
    """
    gap = F.col("skill_gap")
    untaxed = ~(F.col("service_only") & ~F.col("ownership_word"))
    unstable = F.col("short_tenure") & ~F.col("title_chaser")
    environment = F.col("career_environment")
    factor = lambda flag, value: F.when(flag, value).otherwise(1.0)
    by = rules.calibration
    bonus = F.lit(1.0)
    for least, value in sorted(rules.environment_factors):
        bonus = F.when(environment >= least, value).otherwise(bonus)
    score = (F.col("capped_fit")
             * factor(F.col("title_chaser"), by["title_chaser"])
             * factor(~untaxed, by["service_only"])
             * factor(F.col("genai_wrapper"), by["genai_wrapper"])
             * factor(gap > 0, 1 - gap)
             * factor(F.col("research_only"), by["research_only"])
             * factor(unstable, by["short_tenure"])
             * bonus)
    return df.withColumns({
        "calibrated": round_exact(score, 2),
        "penalty_flags": F.array_compact(F.array(
            F.when(F.col("title_chaser"), v.FLAG_CHASER),
            F.when(~untaxed, v.FLAG_SERVICE),
            F.when(F.col("genai_wrapper"), v.FLAG_WRAPPER),
            F.when(gap > 0.05, F.concat(F.lit(v.FLAG_INFLATION + ": -"), fixed_text(gap * 100, 1), F.lit("%"))),
            F.when(F.col("research_only"), v.FLAG_RESEARCH),
            F.when(unstable, v.FLAG_TENURE))),
    })
