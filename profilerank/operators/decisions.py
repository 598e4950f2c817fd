"""Gates, tracks and anomaly rules as a decision table.

A row is (stage, priority, predicate, effect, route, goes_on, weight).  Of a stage ``gate`` or
``track`` the first predicate that holds by priority decides; all rows of ``anomaly`` count, each
as often as its predicate says (a truth value once).  Predicates are SQL over the columns of the
scoring; they are checked against it before anything runs, and become one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from profilerank import vocabulary as v
from profilerank.rules import Rules

MAX_RULES = 1000  # rules become part of the plan; more are refused
DECISION_SCHEMA = "stage string, priority int, predicate string, effect string, route string, goes_on boolean, weight double"


@dataclass(frozen=True)
class Rule:
    predicate: str
    effect: str
    route: str | None
    goes_on: bool | None
    weight: float | None


def decision_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """The rules of the engine as a table, ready to be edited."""
    gates = [("stays_away", "away", v.ROUTE_REJECT, False), ("not has_python", "no_python", v.ROUTE_REJECT, False),
             ("not recent_code", "no_recent_code", v.ROUTE_REJECT, False), ("not ir_anywhere", "no_terms", v.ROUTE_ALTERNATE, False),
             (f"cri < {rules.weak_below}", "weak", v.ROUTE_ALTERNATE, True), (f"cri >= {rules.clear_from}", "clear", v.ROUTE_PASS, True),
             ("rescuable", "rescued", v.ROUTE_PASS, True), ("true", "thin", v.ROUTE_ALTERNATE, True)]
    tracks = [("genai_wrapper", v.TRACK_WRAPPER), ("research_only", v.TRACK_RESEARCH), ("service_only and not ownership_word", v.TRACK_SERVICE),
              ("vision_terms > data_terms and vision_terms >= 2", v.TRACK_VISION), ("data_terms >= 2", v.TRACK_DATA), ("true", v.TRACK_GENERAL)]
    rows = [("gate", i, p, e, r, g, None) for i, (p, e, r, g) in enumerate(gates)]
    rows += [("track", i, p, e, None, None, None) for i, (p, e) in enumerate(tracks)]
    rows += [("anomaly", i, name, name, None, None, float(weight)) for i, (name, weight) in enumerate(rules.anomaly_weights.items())]
    return spark.createDataFrame(rows, DECISION_SCHEMA)


def stage_rules(decisions: DataFrame, stage: str) -> list[Rule]:
    """The rules of a stage by priority; two rules of one priority are refused, as no one could tell the first."""
    rows = decisions.filter(F.col("stage") == stage).orderBy("priority").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules of {stage}")
    for one, two in zip(rows, rows[1:]):
        if one.priority == two.priority:
            raise ValueError(f"two rules of {stage} have the priority {one.priority}")
    return [Rule(r.predicate, r.effect, r.route, r.goes_on, r.weight) for r in rows]


def checked_predicate(df: DataFrame, rule: Rule, kinds: tuple[str, ...] = ("boolean",)) -> Column:
    """The predicate as a column; refused if it can't be read, names unknown columns or has another type."""
    try:
        kind = df.limit(0).select(F.expr(rule.predicate).alias("p")).dtypes[0][1]
    except (AnalysisException, ParseException) as wrong:
        raise ValueError(f"rule {rule.effect!r}: {wrong.getMessage() if hasattr(wrong, 'getMessage') else wrong}") from wrong
    if kind not in kinds:
        raise ValueError(f"rule {rule.effect!r} gives {kind}, not {' or '.join(kinds)}")
    return F.expr(rule.predicate)


def first_match(df: DataFrame, rules: list[Rule]) -> Column:
    """(effect, route, goes_on) of the first rule that holds; null if none does."""
    chain = None
    for rule in rules:
        said = F.struct(F.lit(rule.effect).alias("effect"), F.lit(rule.route).cast("string").alias("route"),
                        F.lit(rule.goes_on).cast("boolean").alias("goes_on"))
        test = checked_predicate(df, rule)
        chain = F.when(test, said) if chain is None else chain.when(test, said)
    if chain is None:
        raise ValueError("a stage needs a rule")
    return chain


def anomaly_factor(df: DataFrame, rules: list[Rule]) -> Column:
    """What the anomalies leave of 1, not below 0; weights are taken off one by one."""
    penalty = F.lit(0.0)
    for rule in rules:
        test = checked_predicate(df, rule, ("boolean", "int", "bigint"))
        times = F.greatest(F.lit(0), F.coalesce(test.cast("int"), F.lit(0)))
        penalty = F.aggregate(F.array_repeat(F.lit(float(rule.weight)), times), penalty, lambda total, x: total + x)
    return F.greatest(F.lit(0.0), 1.0 - penalty)
