"""Scoring rules on hand-made profiles.  All cases are scored in one run."""

import pytest
from pyspark.sql import functions as F

from profilerank import vocabulary as v
from tests.conftest import job, profile

IR = "Built a ranking system in python."
PLAIN = "Built a shop in python."


def past(**kw):
    return job(is_current=False, end_date="2025-06-01", **kw)


def skill(name, level=None, months=0, endorsements=0):
    out = {"name": name, "duration_months": months, "endorsements": endorsements}
    return {**out, "proficiency": level} if level else out


CASES = {
    # evidence
    "contradicted": profile("contradicted", [job(title="HR Manager", description=IR)]),
    "later_current": profile("later_current", [past(description=IR), job(description="ranking"), past(description=IR)]),
    "last_current": profile("last_current", [job(description="ranking"), job(description="ndcg")]),
    "first_past": profile("first_past", [past(description=IR), past(description="ndcg")]),
    "vision_title": profile("vision_title", [job(title="Computer Vision Engineer", description=IR)]),
    "ance": profile("ance", [job(description="python relevance and governance")]),
    "accent": profile("accent", [job(description="python éann")]),
    # missing parts
    "empty": {"candidate_id": "empty"},
    "nulls": {"candidate_id": "nulls", "profile": None, "career_history": [None], "skills": None, "signals": None},
    # gates
    "away": profile("away", head={"location": "Chennai"}),
    "away_first": profile("away_first", [job(description="x")], head={"location": "Chennai"}),
    "moves": profile("moves", head={"location": "Chennai"}, signals={"willing_to_relocate": True}),
    "abroad": profile("abroad", head={"country": " France ", "location": "Paris"}),
    "ghost": profile("ghost", [job(description="x")], signals={"open_to_work_flag": False, "last_active_date": "bad"}),
    "no_terms": profile("no_terms", [job(description=PLAIN)]),
    "no_code": profile("no_code", [job(title="Clerk")]),
    "lead_builds": profile("lead_builds", [job(title="Head of Search")]),
    "lead_talks": profile("lead_talks", [job(title="Head of Search", description="python ranking, rebuilt")]),
    # dates
    "at_cutoff": profile("at_cutoff", [job(is_current=False, end_date="2024-12-22")]),
    "before_cutoff": profile("before_cutoff", [job(is_current=False, end_date="2024-12-21")]),
    "bad_end": profile("bad_end", [job(is_current=False, end_date="soon")]),
    "bad_start": profile("bad_start", [job(start_date="15-06-2024")]),
    "future": profile("future", [job(start_date="2026-07-01")]),
    # titles and tenure
    "chaser": profile("chaser", [past(title="Junior Engineer", start_date="2020-01-01", duration_months=17),
                                 job(title="Senior Engineer", start_date="2021-01-01")]),
    "tenure_18": profile("tenure_18", [past(title="Junior Engineer", start_date="2020-01-01", duration_months=18),
                                       job(title="Senior Engineer", start_date="2021-01-01")]),
    "short": profile("short", [past(title="Senior Engineer", start_date="2020-01-01", duration_months=17),
                               job(title="Engineer", start_date="2021-01-01")]),
    "same_start": profile("same_start", [past(title="Director", duration_months=1), job(title="Engineer")]),
    "tiers": profile("tiers", [past(title=t) for t in ("Junior Engineer", "Principal Engineer", "Contractor", "", "Lead Analyst")]),
    # companies
    "service": profile("service", [job(company="TCS Ltd", description="python ranking work")]),
    "service_owned": profile("service_owned", [job(company="TCS Ltd", description="python ranking owned")]),
    "product": profile("product", [job(industry="FinTech Software", company_size="11-50")]),
    "retail_ai": profile("retail_ai", [job(industry="Retail")]),
    # skills
    "gap_edge": profile("gap_edge", skills=[skill("A", "expert")], signals={"skill_assessment_scores": {"A": 75}}),
    "gap": profile("gap", skills=[skill("A", "expert"), skill("B", "guru"), skill("C")],
                   signals={"skill_assessment_scores": {"A": 70, "B": 40, "Z": 0}}),
    "gap_cap": profile("gap_cap", skills=[skill("A", "expert")] * 9, signals={"skill_assessment_scores": {"A": 0}}),
    # anomalies
    "two_impossible": profile("two_impossible", [job(start_date="2026-01-01", duration_months=7)] * 2),
    "at_grace": profile("at_grace", [job(start_date="2026-01-01", duration_months=6)]),
    "idle_experts": profile("idle_experts", skills=[skill(str(i), "expert") for i in range(5)]),
    "salary": profile("salary", signals={"expected_salary_range_inr_lpa": {"min": 5, "max": 4}}),
    "signup": profile("signup", signals={"signup_date": "2026-06-02"}),
    "stuffed": profile("stuffed", skills=[skill(s) for s in ("NDCG", "MRR", "FAISS", "BM25")],
                       head={"current_title": "Accountant"}),
    "all_odd": profile("all_odd", [job(start_date="2026-01-01", duration_months=70)] * 4),
    # scores
    "nouns": profile("nouns", [job(description="python lambdamart ranking model")]),
    "disclaimed": profile("disclaimed", [job(description="python lambdamart ranking model, secondary")]),
    "full": profile("full", [job(description="python ranking system, owned, deployed in production, ndcg, up 5%")]),
    "buzz": profile("buzz", [job(start_date="2024-02-01", description="built model production deployment inference serving latency monitoring canary")]),
    "nine_nouns": profile("nine_nouns", [job(start_date="2024-02-01", description="model production deployment inference serving latency")]),
    "classic": profile("classic", [job(start_date="", description="ml xgboost lightgbm svm")]),
    "eval_skills": profile("eval_skills", [job(description="python ranking ndcg")], skills=[skill("NDCG"), skill("MRR"), skill("Map")]),
    "eval_title": profile("eval_title", [job(title="NDCG Engineer", description="python ranking")]),
    "wrapper": profile("wrapper", [job(start_date="2023-06-01", description="python llm langchain llamaindex flowise embeddin")]),
    "wrapper_map": profile("wrapper_map", [job(start_date="2023-06-01", description="python llm langchain llamaindex flowise roadmap")]),
    "research": profile("research", [job(description="python collaborated")]),
    "recommender": profile("recommender", [job(description="python recommender, personalization, feed ranking shipped, lifted by 4%")]),
    "sum_not_product": profile("sum_not_product", signals={"recruiter_response_rate": 0.5, "interview_completion_rate": 0.25}),
    "notice": profile("notice", signals={"notice_period_days": 60}),
    "verbs": profile("verbs", [job(description="built built shipped led worked on failed python ranking " + "owned " * 6)]),
}


@pytest.fixture(scope="module")
def rows(score):
    return score(list(CASES.values()))


def test_every_profile_is_scored(rows):
    assert set(rows) == set(CASES)


def test_evidence(rows):
    def pick(name):
        r = rows[name]
        return r.evidence_found, r.evidence_trusted, r.evidence_job and r.evidence_job.pos

    assert pick("contradicted") == (True, False, 0)
    assert pick("vision_title") == (True, False, 0)
    assert pick("later_current") == (True, True, 1)
    assert pick("last_current") == (True, True, 1)
    assert pick("first_past") == (True, True, 0)
    assert pick("ance") == pick("accent") == pick("empty") == (False, False, None)
    assert rows["contradicted"].relevance_ownership == 0 and rows["contradicted"].trust_text == ""


def test_missing_parts_are_defaults(rows):
    for name in ("empty", "nulls"):
        r = rows[name]
        assert (r.route, r.final_score, r.notice_days, r.github) == (v.ROUTE_REJECT, 0.0, 90, -1.0)
        assert r.career_environment == 20.0 and r.cri == 0.0 and r.full_text == " "


def test_gates(rows):
    got = {n: (rows[n].gate, rows[n].route, rows[n].continue_scoring) for n in (
        "away", "away_first", "moves", "no_terms", "no_code", "lead_builds", "lead_talks")}
    assert got["away"] == got["away_first"] == ("away", v.ROUTE_REJECT, False)
    assert got["no_terms"] == ("no_terms", v.ROUTE_ALTERNATE, False)
    assert got["no_code"] == got["lead_talks"] == ("no_recent_code", v.ROUTE_REJECT, False)
    assert got["moves"][1] != v.ROUTE_REJECT and got["lead_builds"][1] != v.ROUTE_REJECT


def test_flags_survive_a_rejection(rows):
    assert rows["abroad"].flags == [f"{v.FLAG_VISA} (Paris, France)"]
    assert rows["ghost"].route == v.ROUTE_REJECT and rows["ghost"].flags == [v.FLAG_PASSIVE]
    assert rows["empty"].flags == [f"{v.FLAG_VISA} (, )", v.FLAG_PASSIVE]


def test_dates(rows):
    recent = {n for n in ("at_cutoff", "before_cutoff", "bad_end", "bad_start", "future") if rows[n].recent_code}
    assert recent == {"at_cutoff", "bad_end"}


def test_titles_and_tenure(rows):
    got = {n: (rows[n].title_chaser, rows[n].short_tenure) for n in ("chaser", "tenure_18", "short", "same_start")}
    assert got == {"chaser": (True, True), "tenure_18": (False, False), "short": (False, True),
                   "same_start": (False, True)}
    assert rows["tiers"].tiers == [2, 4, 5, 2, 3]
    assert v.FLAG_TENURE in rows["short"].penalty_flags
    assert v.FLAG_CHASER in rows["chaser"].penalty_flags and v.FLAG_TENURE not in rows["chaser"].penalty_flags


def test_companies(rows):
    assert rows["service"].service_only and not rows["service"].ownership_word
    assert v.FLAG_SERVICE in rows["service"].penalty_flags
    assert v.FLAG_SERVICE not in rows["service_owned"].penalty_flags
    assert [rows[n].career_environment for n in ("service", "product", "retail_ai", "full")] == [20, 95, 80, 60]


def test_skill_gap(rows):
    assert rows["gap_edge"].skill_gap == 0.0
    assert rows["gap"].skill_gap == 0.0 + (90 - 70 - 15) / 90 * 0.15 + (65 - 40 - 15) / 65 * 0.15
    assert rows["gap_cap"].skill_gap == 1.0 and rows["gap_cap"].final_score == 0.0
    assert rows["gap_cap"].penalty_flags[0] == f"{v.FLAG_INFLATION}: -100.0%"


def test_anomalies(rows):
    factor = {n: rows[n].anomaly_factor for n in (
        "two_impossible", "at_grace", "idle_experts", "salary", "signup", "stuffed", "all_odd")}
    assert factor == {"two_impossible": 0.4, "at_grace": 1.0, "idle_experts": 0.6, "salary": 0.85,
                      "signup": 0.75, "stuffed": 0.8, "all_odd": 0.0}


def test_relevance(rows):
    assert rows["nouns"].relevance_ownership == 35.0
    assert rows["disclaimed"].relevance_ownership == 17.5
    # 25 for the system, 20 deployment, 20 evaluation, 10 outcome, 10 both, 15 ownership
    assert rows["full"].relevance_ownership == 100.0
    assert rows["full"].cri == round(max(0.5 * 100 + 0.3 * 25, 0.55 * 100), 1)
    assert rows["recommender"].recommendation_ownership == 100.0
    # 35 for the terms, 10 for the outcome, 15 for "shipped"
    assert rows["recommender"].relevance_ownership == 60.0
    assert rows["recommender"].cri == round(0.55 * 60 + 0.45 * 100, 1)


def test_scores(rows):
    assert rows["buzz"].production_ml is None  # its scoring stopped at a gate
    assert rows["eval_skills"].evaluation_rigor == 25 + 2 * 7.5
    assert rows["eval_title"].evaluation_rigor == 0.0
    assert rows["sum_not_product"].pipeline_friction == 37.5
    assert rows["notice"].availability_timeline == 60.0
    assert rows["full"].product_ownership == min(30, 8) + min(20, 8) + 20


def test_wrapper_and_research(rows):
    assert rows["wrapper"].genai_wrapper and not rows["wrapper_map"].genai_wrapper
    assert rows["research"].research_only  # the fragment "lab" of "collaborated"
    assert rows["research"].alternate_pipeline == v.TRACK_RESEARCH


def test_verbs(rows):
    r = rows["verbs"]
    assert (r.builder_verbs, r.leader_verbs, r.passive_verbs) == (3, 7, 1)
    assert r.shipping_velocity == round((3 + 3.5) / 11, 3)


def test_confidence(rows):
    r = rows["full"]
    # covered: python, production, evidence, evaluation, activity, outcome
    assert r.coverage == 6 / 7 and r.reliability == 1.0 and r.consistency == 1.0
    assert r.confidence == round((0.4 * 6 / 7 + 0.4 + 0.2) * 100, 1) - 10


def test_final_score(rows):
    r = rows["full"]
    assert r.route == v.ROUTE_PASS and r.capped_fit == min(r.raw_fit, 70)
    assert r.final_score == round(r.calibrated * r.anomaly_factor * (0.80 + 0.20 * (r.confidence / 100.0)), 2)
    assert all(row.final_score <= 30 for row in rows.values() if row.route == v.ROUTE_ALTERNATE)
    assert all(row.final_score == 0 for row in rows.values() if not row.continue_scoring)


def test_production_terms(frame):
    from profilerank.operators.scorecard import production_ml
    from profilerank.operators.texts import with_texts
    from profilerank.rules import Rules
    from profilerank.sources import normalise

    cases = [CASES[n] for n in ("buzz", "nine_nouns", "classic")] + [
        profile("unrelated", [job(title="Accountant", description="built model production, xgboost")])]
    df = with_texts(normalise(frame(cases)), Rules())
    got = {r[0]: r[1] for r in df.select("candidate_id", production_ml(Rules())).collect()}
    # at most four production terms per job; nouns alone do not count; a missing start counts as early
    assert got == {"buzz": 48.0, "nine_nouns": 0.0, "classic": 50.0, "unrelated": 0.0}


def test_rules_can_be_replaced(spark, score):
    from dataclasses import replace
    from datetime import date

    from profilerank.rules import Rules

    terms = spark.createDataFrame([("hubs", "chennai", "substring"), ("ir", "shop", "word")],
                                  "taxonomy string, term string, mode string")
    rules = Rules(terms=v.Vocabulary().with_terms_table(terms), today=date(2024, 6, 1))
    rules = replace(rules, alternate_cap=1.0)
    rows = score([CASES["away"], CASES["no_terms"], CASES["moves"]], rules)
    assert rows["away"].gate != "away"
    assert rows["no_terms"].ir_anywhere and rows["no_terms"].final_score <= 1.0
    with pytest.raises(ValueError):
        v.Vocabulary().with_terms_table(terms.withColumn("mode", terms.term))


def test_recency(spark):
    from pyspark.sql import functions as F

    from profilerank.operators.career import recency_factor
    from profilerank.rules import Rules

    cases = [("2010-01-01", True, 1.0), ("", False, 1.0), ("2023-06-16", False, 0.9), ("2023-06-15", False, 0.7),
             ("2020-06-16", False, 0.7), ("2020-06-14", False, 0.5), ("soon", False, 0.7), ("2026-01-01T00", False, 0.9)]
    df = spark.createDataFrame(cases, "end_date string, is_current boolean, expected double")
    rows = df.withColumn("job", F.struct("end_date", "is_current")).select(
        "expected", recency_factor(F.col("job"), Rules()).alias("got")).collect()
    # 2023-06-15 lies 1096 days back, which is more than three years of 365.25 days
    assert [r.got for r in rows] == [r.expected for r in rows]


def test_fragments_of_texts_are_those_that_contains_finds(frame):
    """Over the seams of joined texts, in other scripts, in no text; the empty fragment is everywhere."""
    from profilerank.functions.fragments import fragments_of_texts
    from profilerank.operators.texts import with_texts
    from profilerank.rules import Rules
    from profilerank.sources import normalise

    cases = [profile("a", jobs=[job(title="Été Lead", description="Ranked search"), job(title="", description="systems; search rank")],
                     skills=[{"name": "Vector"}, {"name": "Store"}], head={"summary": "Über search"}),
             profile("b", jobs=[]), profile("c", jobs=[job(title="x", description="")])]
    terms = ["search", "search été", "search systems", "r", "vector store", "é", "rank", "ank", "lead systems", "über", "", "nowhere"]
    for row in with_texts(normalise(frame(cases)), Rules()).withColumn("found", fragments_of_texts(terms)).collect():
        for name in ("full", "career", "skills", "trust"):
            assert set(row.found[name]) == {t for t in terms if t in row[f"{name}_text"]}, (row.candidate_id, name)
        assert [(set(f.desc), set(f.title)) for f in row.found.jobs] == [
            ({t for t in terms if t in j.desc}, {t for t in terms if t in j.title}) for j in row.jobs]


def test_long_texts_are_not_read_once_for_every_fragment(frame):
    """Before, every test of a score searched the whole text for each fragment of its list."""
    from profilerank.functions.text import any_term, count_terms
    from profilerank.operators.texts import CAREER, FULL, with_texts
    from profilerank.rules import Rules
    from profilerank.sources import normalise

    terms, df = Rules().terms, with_texts(normalise(frame([profile("a")])), Rules())
    row = df.withColumns({"career_text": F.lit(""), "full_text": F.lit("")}).select(
        any_term(terms.rescue, *CAREER), count_terms(terms.ir, *FULL)).first()
    assert row[0] and row[1] > 0
