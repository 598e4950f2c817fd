"""How far the record itself can be relied on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from profilerank.functions.dates import days_before, iso_date_prefix
from profilerank.functions.numbers import compensated_sum, round_exact
from profilerank.functions.outcomes import has_percent_or_times
from profilerank.functions.text import any_term
from profilerank.operators.texts import CAREER, FULL, SKILLS
from profilerank.rules import Rules


def with_confidence(df: DataFrame, rules: Rules) -> DataFrame:
    """0.4 coverage + 0.4 reliability + 0.2 consistency, in percent.

    Coverage is the share of seven signals present.  Reliability is the mean
    weight of the sources that were found, career above skills.  Consistency
    drops for relevance claims without career evidence and for inflated
    skills.  A career text with few verbs costs ten points.
    """
    t = rules.terms
    career, skills = "career_text", "skills_text"
    idle = days_before(rules.today, iso_date_prefix(F.col("last_active")))
    signals = [
        F.col("has_python"),
        any_term(t.covered_production, *CAREER),
        F.col("evidence_trusted"),
        any_term(t.covered_eval, *FULL),
        F.coalesce(idle <= 90, F.lit(False)),
        F.col("verified"),
        F.col("career_outcome"),
    ]
    covered = sum((s.cast("int") for s in signals[1:]), signals[0].cast("int"))
    sources = F.array_compact(F.array(
        F.when(F.col(career).contains("python"), 1.0).when(F.col(skills).contains("python"), 0.5),
        F.when(any_term(t.reliable_production, *CAREER), 1.0),
        F.when(F.col("evidence_trusted"), 1.0).when(F.col("ir_anywhere"), 0.5),
        F.when(any_term(t.reliable_eval, *CAREER), 1.0).when(any_term(t.skill_eval, *SKILLS), 0.5),
        F.when(F.col("github") > 20, 0.9),
        F.when(F.col("verified"), 1.0),
        F.when(has_percent_or_times(career), 1.0)))
    df = df.withColumns({"_covered": covered, "_sources": sources})
    unproven = F.col("ir_anywhere") & ~F.col("evidence_trusted")
    consistency = F.greatest(
        F.lit(0.0),
        1.0 - F.when(unproven, 0.3).otherwise(0.0) - F.when(F.col("skill_gap") > 0.05, 0.2).otherwise(0.0))
    df = df.withColumns({
        "coverage": F.col("_covered") / 7,
        "reliability": F.when(F.size("_sources") > 0, compensated_sum(F.col("_sources")) / F.size("_sources"))
        .otherwise(0.3),
        "consistency": consistency,
    })
    score = round_exact((F.lit(0.4) * F.col("coverage") + F.lit(0.4) * F.col("reliability")
                         + F.lit(0.2) * F.col("consistency")) * 100, 1)
    df = df.withColumn("_confidence", score)
    return df.withColumn(
        "confidence",
        F.when(F.col("all_verbs") < 10, F.greatest(F.lit(0.0), F.col("_confidence") - 10))
        .otherwise(F.col("_confidence"))).drop("_covered", "_sources", "_confidence")
