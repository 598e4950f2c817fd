"""Text, number, date and outcome helpers against plain Python."""

import math
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from profilerank import vocabulary as v
from profilerank.functions import dates, numbers, outcomes, text

TERMS = v.phrases_or_words(["ann", "map", "led", "ctr", "ance", "re-rank", "hybrid search", "search engine", "<100"])


def features(spark, texts, terms):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    df = df.withColumn("w", F.expr(text.words_sql("t", terms.words)))
    rows = df.select("i", text.any_term(terms, "t", "w").alias("hit"), text.count_terms(terms, "t", "w").alias("n"),
                     text.count_occurrences(terms, "t", "w").alias("total")).orderBy("i").collect()
    return [(r.hit, r.n, r.total) for r in rows]


def brute(t, terms):
    counts = [t.count(x) for x in terms.fragments]
    counts += [len(re.findall(r"\b" + re.escape(x) + r"\b", t)) for x in terms.words + terms.bounded]
    return any(counts), sum(c > 0 for c in counts), sum(counts)


def test_words_are_not_found_inside_other_words(spark):
    texts = ["planning the roadmap", "failed, handled, scaled", "relevance and governance", "doctrine electric",
             "ann. map; led", "an ance-based ctr", "naïveann ann", "annß ann", "éled led_ led", ""]
    assert features(spark, texts, TERMS) == [brute(t, TERMS) for t in texts]


def test_terms_with_other_characters(spark):
    terms = v.whole_words(["precision@", "worked on"])
    texts = ["precision@10", "precision@ 10", "xprecision@10", "worked on it, worked on that", "networked on",
             "worked  on"]
    assert features(spark, texts, terms) == [brute(t, terms) for t in texts]


def test_overlapping_terms_count_each(spark):
    terms = v.fragments(["ranking system", "system design", "learning-to-rank", "learning"])
    assert features(spark, ["a ranking system design", "learning-to-rank"], terms) == [(True, 2, 2), (True, 2, 2)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aenmplrd c-<1é_.0\n", max_size=40), min_size=20, max_size=60))
def test_any_text_matches_like_brute_force(spark, texts):
    assert features(spark, texts, TERMS) == [brute(t, TERMS) for t in texts]


@pytest.mark.parametrize("name", ["ir", "strong", "evaluation", "disclaimers", "passive_verbs"])
def test_every_term_finds_itself(spark, name):
    terms = getattr(v.Vocabulary(), name)
    texts = [f"x {t}1" if t in terms.bounded and t.endswith("@") else f"x {t} y" for t in terms.terms]
    assert all(hit for hit, _, _ in features(spark, texts, terms))


def test_a_text_used_once_is_not_assembled_per_term(spark):
    df = spark.range(1).select(F.concat(F.col("id").cast("string"), F.lit(" ann")).alias("t"))
    plan = df.select(text.any_term(v.fragments(["ann", "map"]), "t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat") == 1 and "contains(concat" not in plan.lower()


def test_difference_of_terms(spark):
    terms = v.phrases_or_words(["ndcg", "mrr", "ab test", "recall@"])
    df = spark.createDataFrame([("ndcg mrr recall@5 ab test", "mrr"), ("ndcg", "ndcg")], "a string, b string")
    for c in "ab":
        df = df.withColumn(c + "w", F.expr(text.words_sql(c, terms.words)))
    got = df.select(text.count_other_terms(terms, "a", "aw", "b", "bw")).collect()
    assert [r[0] for r in got] == [3, 0]


def test_rounding_is_that_of_the_exact_value(spark):
    values = [2.675, 28.125, 0.25, 62.25, 6.25, 0.125, 1.005, 0.0, 100.0] + [i / 1000 for i in range(0, 3000, 5)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (0, 1, 2, 3):
        rows = df.select("x", numbers.round_exact(F.col("x"), digits).alias("r"),
                         numbers.fixed_text(F.col("x"), digits).alias("t")).collect()
        assert all(r.r == round(r.x, digits) and r.t == f"{r.x:.{digits}f}" for r in rows)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.floats(0, 100), min_size=1, max_size=8), min_size=5, max_size=20))
def test_sum_is_exact_to_the_last_bit_or_two(spark, lists):
    rows = spark.createDataFrame([(x,) for x in lists], "x array<double>").select(
        "x", numbers.compensated_sum(F.col("x")).alias("s")).collect()
    assert all(abs(r.s - math.fsum(r.x)) <= math.ulp(r.s) for r in rows)


def test_only_full_iso_dates_are_dates(spark):
    texts = ["2026-06-15", "15-06-2026", "2026-6-5", "2026", "", "  ", "2026-06-15T10:00", "2026-02-30", "2026-06-15\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        dates.iso_date(F.col("t")).alias("whole"), dates.iso_date_prefix(F.col("t")).alias("start")).collect()
    assert [str(r.whole) for r in rows] == ["2026-06-15"] + ["None"] * 8
    assert [str(r.start) for r in rows] == ["2026-06-15"] + ["None"] * 5 + ["2026-06-15", "None", "2026-06-15"]


def test_outcomes(spark):
    texts = [
        "improved revenue by 12%. reported search-relevance improvement of 35%",
        "cut by 5% and lifted  ctr 5 %",
        "saw the a an lift of 7%",
        "reduced cost 3x ", "4 x faster, 12.5 x cheaper, 12.5 x better", "improved documentation",
        "ctr improved", "+4.2pp engagement", "nothing",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(
        outcomes.outcomes(F.col("t")).alias("all"), outcomes.best_factor(F.col("t")).alias("factor"),
        outcomes.has_loose_outcome("t").alias("loose"), outcomes.has_strict_outcome("t").alias("strict"),
    ).orderBy("i").collect()
    assert [[(o.verb, o.metric, o.amount) for o in r["all"]] for r in rows[:3]] == [
        [("improved", "revenue", "12"), ("reported", "search-relevance", "35")],
        [("cut", "a key metric", "5"), ("lifted", "ctr", "5")],
        [("reported", "an", "7")],
    ]
    assert [r.factor for r in rows] == [None, None, None, "3", "12.5", None, None, None, None]
    assert [r.loose for r in rows] == [True, True, True, True, False, True, True, False, False]
    assert [r.strict for r in rows] == [True, True, True, True, False, False, True, True, False]


def test_best_outcome_is_the_first_of_equals(spark):
    df = spark.createDataFrame([("grew a by 9%, cut b by 9%, gain of 9%",), ("none",)], "t string")
    rows = df.select(outcomes.best_outcome(outcomes.outcomes(F.col("t"))).alias("b")).collect()
    assert (rows[0].b.verb, rows[0].b.metric) == ("grew", "a") and rows[1].b is None


def test_outcome_numbers_of_any_script(spark):
    df = spark.createDataFrame([("improved ctr by ٥% and faster ٥ x ",), ("improved ctr by 12.5%, 3 x more, 4 x ",)], "t string")
    rows = df.select(outcomes.best_outcome(outcomes.outcomes(F.col("t"))).alias("o"),
                     outcomes.best_factor(F.col("t")).alias("f")).collect()
    assert [(r.o.value, r.f) for r in rows] == [(5.0, "٥"), (12.5, "4")]


def test_words_without_a_word_array(spark):
    from profilerank.functions import text
    from profilerank.vocabulary import TermList
    terms = TermList(fragments=("rank",), words=("go", "ml"), bounded=())
    df = spark.createDataFrame([("the go ranking",), ("gopher mlops",)], "t string")
    rows = df.select(text.any_term(terms, "t").alias("a"), text.count_terms(terms, "t").alias("n")).collect()
    assert [(r.a, r.n) for r in rows] == [(True, 2), (False, 0)]
