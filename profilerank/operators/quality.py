"""Anomaly rules: records that cannot be true."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from profilerank.functions.text import any_term, count_terms
from profilerank.operators.decisions import anomaly_factor, stage_rules
from profilerank.rules import Rules


def with_anomalies(df: DataFrame, rules: Rules, decisions: DataFrame | None = None) -> DataFrame:
    """One column per rule, and the multiplier they leave (0 to 1).

    A job is impossible if it lasted longer than the time since its start
    year, with half a year of grace; each such job counts.  ``decisions`` may replace the weights, and add
    rules, by a decision table.
    """
    df = df.withColumns({
        "impossible_jobs": F.expr(f"""size(filter(jobs, j -> coalesce(
            j.months > ({rules.today.year} - try_cast(substring(j.start_date, 1, 4) as int)) * 12 + 6, false)))"""),
        "idle_experts": F.expr("""size(filter(skills, s -> s.proficiency in ('advanced', 'expert')
            and s.months = 0 and s.endorsements = 0)) >= 5"""),
        "inverted_salary": (F.col("salary_min") > F.col("salary_max")) & (F.col("salary_max") > 0),
        "active_before_signup": F.expr("signup != '' and last_active != '' and signup > last_active"),
        "_title": F.lower(F.coalesce("current_title", F.lit(""))),
    }).withColumn(
        "stuffed_skills", any_term(rules.terms.non_tech_titles, "_title")
        & (count_terms(rules.terms.ir, "skills_text", "skills_words") >= 4)).drop("_title")
    if decisions is not None:
        return df.withColumn("anomaly_factor", anomaly_factor(df, stage_rules(decisions, "anomaly")))
    # Added up one by one: three times 0.3 is not 0.9 in doubles.
    weights = rules.anomaly_weights
    penalties = F.expr(f"aggregate(array_repeat({float(weights['impossible_jobs'])!r}D, impossible_jobs), 0D, (acc, x) -> acc + x)")
    for rule in ("idle_experts", "inverted_salary", "active_before_signup", "stuffed_skills"):
        penalties = penalties + F.when(F.col(rule), float(weights[rule])).otherwise(0.0)
    return df.withColumn("anomaly_factor", F.greatest(F.lit(0.0), 1.0 - penalties))
