import pytest
from pyspark.sql import functions as F

from profilerank.operators.decisions import DECISION_SCHEMA, checked_predicate, Rule, decision_table
from profilerank.operators.gates import with_alternate_track, with_gates
from profilerank.operators.quality import with_anomalies
from profilerank.operators.scorecard import with_core_scores, with_relevance_index
from profilerank.plans.scoring import with_features
from profilerank.rules import Rules
from profilerank.sources import normalise
from tests.conftest import job, profile

RULES = Rules()


@pytest.fixture(scope="module")
def scores(frame):
    rows = [profile("plain"), profile("away", head={"location": "Nowhere"}), profile("old", jobs=[job(end_date="2019-01-01", is_current=False)]),
            profile("none", jobs=[job(description="Sold python books.")]), profile("idle", signals={"open_to_work_flag": False, "last_active_date": "2020-01-01"}),
            profile("odd", signals={"signup_date": "2026-06-02", "expected_salary_range_inr_lpa": {"min": 9.0, "max": 3.0}})]
    return (with_features(normalise(frame(rows)), RULES).transform(with_core_scores, RULES).transform(with_relevance_index, RULES)).cache()


def decided(scores, table):
    done = (scores.transform(with_gates, RULES, table).transform(with_alternate_track, RULES, table).transform(with_anomalies, RULES, table))
    return {r.candidate_id: r for r in done.select(
        "candidate_id", "route", "passed_gates", "continue_scoring", "flags", "alternate_pipeline", "anomaly_factor").collect()}


def with_rows(spark, *rows):
    return decision_table(spark, RULES).union(spark.createDataFrame(list(rows), DECISION_SCHEMA))


def test_default_rules_decide_the_same(spark, scores):
    assert decided(scores, decision_table(spark, RULES)) == decided(scores, None)


def test_added_rows_need_no_code(spark, scores):
    table = with_rows(spark, ("gate", -1, "github < 0 and candidate_id = 'plain'", "no_code_shown", "hard_reject", False, None),
                      ("track", -1, "notice_days >= 90", "Later", None, None, None),
                      ("anomaly", 99, "if(candidate_id = 'odd', 2, 0)", "twice", None, None, 0.125))
    before, after = decided(scores, None), decided(scores, table)
    assert (after["plain"].route, after["plain"].continue_scoring, after["plain"].passed_gates) == ("hard_reject", False, False)
    assert after["away"].route == before["away"].route and after["none"].alternate_pipeline == "Later"
    assert after["odd"].anomaly_factor == pytest.approx(before["odd"].anomaly_factor - 0.25)
    assert "gate" not in after["plain"].asDict() and before["odd"].anomaly_factor == pytest.approx(0.6)


def test_wrong_rules_are_refused(spark, scores):
    for predicate, effect in (("no_such_column > 1", "unknown"), ("cri >", "unreadable"), ("cri + 1", "no truth value")):
        with pytest.raises(ValueError, match=effect):
            checked_predicate(scores, Rule(predicate, effect, None, None, None))
    with pytest.raises(ValueError, match="priority"):
        decided(scores, with_rows(spark, ("gate", 0, "true", "x", "pass", True, None)))
    with pytest.raises(ValueError, match="needs a rule"):
        decided(scores, decision_table(spark, RULES).filter(F.col("stage") != "gate"))
