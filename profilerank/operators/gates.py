"""Gates and routes: which records pass, which go elsewhere, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from profilerank import vocabulary as v
from profilerank.functions.dates import days_before, iso_date
from profilerank.functions.text import any_term, count_terms
from profilerank.operators.decisions import first_match, stage_rules
from profilerank.operators.texts import CAREER, FULL
from profilerank.rules import Rules

BLANKS = " \t\n\r\x0b\x0c"


def with_gates(df: DataFrame, rules: Rules, decisions: DataFrame | None = None) -> DataFrame:
    """Route by the first gate that applies; flags raised on the way are kept.

    ``decisions`` may replace the gates by the rules of a decision table, which may also ask for
    ``stays_away`` and ``rescuable``.

    A record whose relevance index is only moderate passes if it names a
    recommender or search system, scores well on relevance and shows
    deployment or an outcome.
    """
    t = rules.terms
    df = df.withColumns({
        "_country": F.btrim("country", F.lit(BLANKS)),
        "_location": F.lower("location"),
        "_idle": F.coalesce(days_before(rules.today, iso_date(F.col("last_active"))), F.lit(999)),
    }).withColumn("_home", F.lower("_country").isin(*v.HOME_COUNTRY))

    stays_away = (F.col("_home") & ~any_term(t.hubs, "_location")
                  & ~F.coalesce(F.col("relocate"), F.lit(False)))
    substance = (any_term(t.deploy_or_shipped, *CAREER) & ~F.col("career_disclaimed")) | F.col("career_outcome")
    rescued = any_term(t.rescue, *CAREER) & (F.col("relevance_ownership") > rules.rescue_above) & substance
    gate = (F.when(stays_away, "away")
            .when(~F.col("has_python"), "no_python")
            .when(~F.col("recent_code"), "no_recent_code")
            .when(~F.col("ir_anywhere"), "no_terms")
            .when(F.col("cri") < rules.weak_below, "weak")
            .when(F.col("cri") >= rules.clear_from, "clear")
            .when(rescued, "rescued").otherwise("thin"))
    if decisions is None:
        df = df.withColumn("gate", gate)
    else:
        df = df.withColumns({"stays_away": stays_away, "rescuable": rescued})
        df = df.withColumn("_decided", first_match(df, stage_rules(decisions, "gate"))).withColumn("gate", F.col("_decided.effect"))

    visa = F.concat(F.lit(v.FLAG_VISA + " ("), F.col("location"), F.lit(", "), F.col("_country"), F.lit(")"))
    if decisions is None:
        route = (F.when(F.col("gate").isin("clear", "rescued"), v.ROUTE_PASS)
                 .when(F.col("gate").isin("away", "no_python", "no_recent_code"), v.ROUTE_REJECT)
                 .otherwise(v.ROUTE_ALTERNATE))
        going_on = ~F.col("gate").isin("away", "no_python", "no_recent_code", "no_terms")
    else:  # what no rule decides is scored elsewhere
        route, going_on = F.coalesce("_decided.route", F.lit(v.ROUTE_ALTERNATE)), F.coalesce("_decided.goes_on", F.lit(False))
    return df.withColumns({
        "passed_gates": F.col("gate").isin("clear", "rescued") if decisions is None else route == v.ROUTE_PASS,
        "route": route,
        "continue_scoring": going_on,
        "flags": F.array_compact(F.array(
            F.when(~F.col("_home"), visa),
            F.when(~F.col("open_to_work") & (F.col("_idle") > 180), v.FLAG_PASSIVE),
            F.when(F.col("gate") == "rescued", v.FLAG_RESCUED))),
    }).drop("_country", "_location", "_idle", "_home", "_decided", "stays_away", "rescuable")


def with_alternate_track(df: DataFrame, rules: Rules, decisions: DataFrame | None = None) -> DataFrame:
    """Where a record that does not pass would fit instead.

    ``decisions`` may replace the tracks by the rules of a decision table, which may also ask for
    ``data_terms`` and ``vision_terms``.
    """
    t, elsewhere = rules.terms, F.col("route") != v.ROUTE_PASS
    df = df.withColumns({
        "_data": F.when(elsewhere, count_terms(t.data_infra, *FULL)),
        "_vision": F.when(elsewhere, count_terms(t.vision_audio, *FULL))})
    track = (F.when(F.col("genai_wrapper"), v.TRACK_WRAPPER)
             .when(F.col("research_only"), v.TRACK_RESEARCH)
             .when(F.col("service_only") & ~F.col("ownership_word"), v.TRACK_SERVICE)
             .when((F.col("_vision") > F.col("_data")) & (F.col("_vision") >= 2), v.TRACK_VISION)
             .when(F.col("_data") >= 2, v.TRACK_DATA)
             .otherwise(v.TRACK_GENERAL))
    if decisions is not None:
        known = df.withColumns({"data_terms": F.col("_data"), "vision_terms": F.col("_vision")})
        df, track = known, first_match(known, stage_rules(decisions, "track"))["effect"]
    return df.withColumn(
        "alternate_pipeline",
        F.when(elsewhere, track).otherwise(v.TRACK_NONE)).drop("_data", "_vision", "data_terms", "vision_terms")
