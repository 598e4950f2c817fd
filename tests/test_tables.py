"""Operators that take terms, phrases, outcome words, weights or tiers from tables."""

import random
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilerank.functions.outcomes import has_strict_outcome
from profilerank.operators import term_tables
from profilerank.operators.outcome_tables import change_pairs, outcome_table, strict_outcomes
from profilerank.operators.phrase_tables import claims, phrase_table
from profilerank.operators.positions import carried_forward, ranks, running_total
from profilerank.operators.ranking import order_violations_of_all, ranked_all
from profilerank.operators.scorecards import top_by_scorecard
from profilerank.operators.term_tables import term_table_hits
from profilerank.operators.tiers import with_tier
from tests.test_ranking import plan

WORD = r"[^\W]"


def count(term, mode, text):
    term, text = term.lower(), text.lower()
    if mode == "substring":
        return text.count(term)
    first = rf"(?<!{WORD})" if re.match(WORD, term[0]) else rf"(?<={WORD})"
    last = rf"(?!{WORD})" if re.match(WORD, term[-1]) else rf"(?={WORD})"
    return len(re.findall(first + re.escape(term) + last, text))


def test_term_hits_of_any_term(spark, monkeypatch):
    monkeypatch.setattr(term_tables, "HOT_TEXTS", 5)
    r = random.Random(1)
    words = ["data", "pipe", "line", "été", "a", "an", "re", "learn", "learning", "x2", "c++", "precision@", "—", "data-line"]
    texts = [(i, "".join(r.choice(words) + r.choice([" ", " ", ", ", "-", "", "? "]) for _ in range(r.randint(0, 30)))) for i in range(60)]
    texts += [(3, "data data"), (None, "Learning DATA"), (100, None), (101, ""), (102, "a\\Eb a\\Eb")]
    terms = [(t, m) for m in ("word", "substring") for t in (
        "data", "DATA", "learn", "ear", "e", "a data", "ta pi", "data, line", "precision@", "@", "??", "? ", "c++", "+", "—", "été", "t", "rn re", "a\\Eb",
        "data pipe line", "nothing here", "-", "n-d", " a ", "x2")] + [("", "word"), (None, "word"), (" ", "substring"), ("data", "other")]
    df = spark.createDataFrame(texts, "id int, text string").withColumn("word", F.lit("x")).repartition(3)
    table = spark.createDataFrame(terms, "term string, mode string")
    got = {(r.id, r.term, r.mode): r.n for r in term_table_hits(df, ["id"], "text", table).collect()}
    want = {}
    for i, text in texts:
        for term, mode in {(t.lower(), m) for t, m in terms if t and t.strip() and m in ("word", "substring")}:
            if text and (n := count(term, mode, text)):
                want[i, term, mode] = want.get((i, term, mode), 0) + n
    assert got == want
    assert term_table_hits(df.limit(0), ["id"], "text", table).count() == 0
    assert term_table_hits(df, ["id"], "text", table.limit(0)).count() == 0


def test_terms_of_several_words_meet_only_the_texts_that_have_them(spark, monkeypatch):
    """A fragment over a gap is not looked for in every text with a word that ends like it; places that share letters count once."""
    texts = [(i, f"thing {'ran' if i else 'thus'} anew, king{i} only") for i in range(40)]
    texts += [(50, "an an an an"), (51, "banan anan  an, an\nan an"), (52, "of of of, of of"), (53, "pta ptab pta pt"), (54, "a\\Eb a\\Eb a")]
    texts += [(55, "data pipe line data pipe line data pipe"), (55, "an an"), (None, "thing thus thing thus")]
    terms = [(t, m) for m in ("word", "substring") for t in (
        "ng th", "ng thus", "thing thus", "g t", "ng w", "ing x", "an an", "n a", "nan anan", "of of", "ta pt", "a pt", "b a", "pipe line data", "ipe line da",
        "ne data pi", "thing thus ", ", ki", "an  a", "an\nan", "king7 only", "ing7 on", "g8 o")]
    met, plain_written = [], term_tables.written
    monkeypatch.setattr(term_tables, "written", lambda df, name: met.append((name, out := plain_written(df, name))) or out)
    df, table = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(terms, "term string, mode string")
    got = {(r.id, r.term, r.mode): r.n for r in term_table_hits(df, ["id"], "text", table).collect()}
    want = {}
    for i, text in texts:
        for term, mode in terms:
            if n := count(term, mode, text):
                want[i, term, mode] = want.get((i, term, mode), 0) + n
    assert got == want
    assert dict(met)["met"].filter("id < 40").count() == len([1 for i, _, _ in want if i is not None and i < 40])


def test_many_terms_are_no_part_of_the_plan(spark):
    terms = spark.range(100_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("term"), F.lit("word").alias("mode"))
    texts = spark.range(40).select("id", F.expr("concat_ws(' ', transform(sequence(id, id * 2500, 100), x -> 'w' || x))").alias("text"))
    hits = term_table_hits(texts, ["id"], "text", terms)
    shown = plan(hits)
    assert "w99999" not in shown and "NestedLoop" not in shown and "Cartesian" not in shown and "Python" not in shown
    assert hits.count() == texts.select(F.explode(F.array_distinct(F.split("text", " "))).alias("w")).count()


def test_claims_by_priority_and_guard(spark):
    rows = [(1, "Owned the ranking layer, then search quality"), (2, "simpler than a ranking layer; " + "and " * 20 + "a ranker too"),
            (3, "nowhere near search quality. bm25"), (4, "nothing"), (5, None), (6, "added phrase and a ranker")]
    table = phrase_table(spark).union(spark.createDataFrame([("phrase", -1, "Added Phrase", "said anew", "said anew")], "a string, b int, c string, d string, e string"))
    got = {r.id: (r.phrase, r.topic) for r in claims(spark.createDataFrame(rows, "id int, text string"), ["id"], "text", table).collect()}
    assert got[1][0] == "owned the ranking layer end-to-end" and got[2][0] == "shipped a ranker in production"
    assert got[3] == (None, "shipped hybrid/dense retrieval in production") and 4 not in got and 5 not in got
    assert got[6][0] == "said anew"


def test_strict_outcomes_equal_the_pattern(spark):
    r = random.Random(3)
    pieces = ["improved", "reduced", "cut", "ctr", "map", "latency", "search", "team", "big-budget", ".", "   ", "went from", "from 3", "from x", "by", "grew"]
    texts = [(i, "".join(r.choice(pieces) + r.choice([" ", " ", "", "-"]) for _ in range(r.randint(1, 9)))) for i in range(400)]
    texts += [(900, "5 pp"), (901, "3x more"), (902, None), (903, "improved" + " " * 200 + "ctr"), (904, "improved " + "a" * 31 + " ctr"),
              (None, "ctr went from here"), (905, "improvedctr"), (906, "mapcut")]
    df = spark.createDataFrame(texts, "id int, text string").repartition(3)
    got = {r.id: r.strict for r in strict_outcomes(df, ["id"], "text", outcome_table(spark)).collect()}
    want = {r.id: bool(r.s) for r in df.select("id", has_strict_outcome("text").alias("s")).collect()}
    assert got == want and 50 < sum(got.values()) < 380
    one = change_pairs(spark.createDataFrame([(1, "we improved the ctr")], "id int, text string"), ["id"], "text", outcome_table(spark))
    assert [tuple(x) for x in one.collect()] == [(1, "improved", "ctr", 5)]


def test_scorecards(spark, monkeypatch):
    from profilerank.operators import scorecards
    monkeypatch.setattr(scorecards, "PASS_CARDS", 300)
    monkeypatch.setattr(scorecards, "BLOCK", 40)
    r = random.Random(5)
    rows = [(f"p{i:03d}", r.choice([0.0, 12.5, 33.3333, 100.0]), r.random() * 100, None if i % 7 == 0 else 50.0) for i in range(120)]
    weights = [(c, s, float((c * 7 + k * 3) % 11) / 2) for c in range(1000) for k, s in enumerate("abc")] + [(3, "a", 1.0)]
    df = spark.createDataFrame(rows, "candidate_id string, a double, b double, c double").repartition(4)
    best = top_by_scorecard(df, "candidate_id", ["a", "b", "c"], spark.createDataFrame(weights, "scorecard int, score string, weight double"), 3)
    got = {}
    for x in best.collect():
        got.setdefault(x.scorecard, {})[x.rank] = (x.candidate_id, x.points)
    assert len(got) == 1000
    total = {c: {} for c in (0, 3, 999)}
    for c in total:
        w = {s: sum(round(x * 10_000) for k, t, x in weights if k == c and t == s) for s in "abc"}
        sums = {k: sum(round((v or 0.0) * 10_000) * w[s] for s, v in zip("abc", values)) for k, *values in rows}
        order = sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:3]
        assert [got[c][i] for i in (1, 2, 3)] == order
    with pytest.raises(ValueError):
        top_by_scorecard(df, "candidate_id", ["a"], spark.createDataFrame([(1, "z", 1.0)], "scorecard int, score string, weight double"), 3).count()


def test_scorecards_meet_every_row_in_parts(spark, monkeypatch):
    """Ties, keys that repeat or are null, and a scorecard of weight 0, over several parts and blocks; no row for every sum."""
    from profilerank.operators import scorecards
    monkeypatch.setattr(scorecards, "PART_ROWS", 40)
    monkeypatch.setattr(scorecards, "BLOCK", 2)
    rows = [(None if i % 50 == 0 else f"p{i % 90:03d}", float(i % 3), float(i % 5)) for i in range(150)]
    weights = [(None if c == 4 else c, s, float(c * (k + 1))) for c in range(5) for k, s in enumerate("ab")]
    df = spark.createDataFrame(rows, "key string, a double, b double").repartition(3)
    best = top_by_scorecard(df, "key", ["a", "b"], spark.createDataFrame(weights, "scorecard long, score string, weight double"), 4)
    assert "FlatMapCoGroupsInArrow" in plan(best) and "Generate explode(_cards" not in plan(best)
    got = {}
    for x in sorted(best.collect(), key=lambda x: x.rank):
        got.setdefault(x.scorecard, []).append((x.key, x.points, x.total))
    for c in (None, 0, 1, 2, 3):
        w = 4 if c is None else c
        sums = sorted(((-(a * w + b * w * 2), k or "", k) for k, a, b in rows))[:4]
        assert got[c] == [(k, int(-s * 10 ** 8), -s / 100) for s, _, k in sums]


def test_scorecard_sums_beyond_doubles():
    from profilerank.operators.scorecards import best_places
    values, weights = np.array([[2 ** 31, 0], [2 ** 31, 1]]), np.array([[2 ** 30, 1]])
    assert [x.tolist() for x in best_places(values, weights, 1)] == [[0], [1], [2 ** 61 + 1]]
    with pytest.raises(OverflowError):
        best_places(values * 4, weights * 4, 1)


@pytest.mark.parametrize("few", [0, 256])
def test_tiers(spark, few):
    tiers = spark.createDataFrame([(None, 0.0, "low"), (0.0, 10.0, "mid"), (10.0, 20.0, "high")], "lower double, upper double, name string")
    rows = [(-5.0,), (0.0,), (9.99,), (10.0,), (20.0,), (None,), (99.0,)] + [(5.0,)] * 50
    df = spark.createDataFrame(rows, "x double").withColumns({"lower": F.lit(1), "c0": F.lit(2)}).repartition(5)
    got = sorted((str(r.x), r.tier) for r in with_tier(df, "x", tiers, "name", "tier", few=few).collect())
    want = {-5.0: "low", 0.0: "mid", 9.99: "mid", 10.0: "high", 20.0: None, None: None, 99.0: None, 5.0: "mid"}
    assert got == sorted((str(x), want[x]) for (x,) in rows)
    for bad in ([(0.0, 5.0), (4.0, 9.0)], [(0.0, 5.0), (6.0, 9.0)], [(0.0, 0.0)]):
        with pytest.raises(ValueError):
            with_tier(df, "x", spark.createDataFrame([(*b, "t") for b in bad], "lower double, upper double, name string"), "name", "t")


def test_positions_of_all_rows(spark):
    r = random.Random(7)
    rows = [(r.choice(["a", "b", None]) if i % 3 else "hot", r.randint(0, 9), r.choice([1, 5, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, v long").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else one range holds so few rows
    try:
        got = running_total(df, ["o"], "v", ["g"]).collect()
        filled = carried_forward(df, [F.col("o").asc()], "v", "last").collect()
        ranked = ranks(df, [F.col("o").desc()])
        assert sorted(x["rank"] for x in ranked.collect()) == list(range(1, 501))
        assert plan(ranked).count("SinglePartition") == 1  # of the range totals
        scores = df.selectExpr("monotonically_increasing_id() AS candidate_id", "cast(o AS double) AS final_score")
        table = ranked_all(scores)
        assert tuple(order_violations_of_all(table).first()) == (500, 0)
        spoilt = table.withColumn("final_score", F.when(F.col("rank").isin(100, 333), 50.0).otherwise(F.col("final_score")))
        assert tuple(order_violations_of_all(spoilt).first()) == (500, 2)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for g in ("a", "b", None, "hot"):
        total, seen = 0, sorted((x for x in got if x.g == g), key=lambda x: (x.o, x.before))
        for o in range(10):
            some = [x for x in seen if x.o == o]
            assert all(total <= x.before <= total + sum(y.v or 0 for y in some) for x in some)
            total += sum(y.v or 0 for y in some)
    first = min(x.o for x in filled if x.v is not None)
    assert all(x.last is not None for x in filled if x.o > first)


def test_entry_without_a_corpus_library():
    """A library of the corpus operators that is missing costs their queries and no others."""
    code = ("import sys; sys.modules['ahocorasick'] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; "
            "assert len(e.queries()) >= 69 and not any(k.startswith('op1') for k in e.queries()); assert 'top_n' in e.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_fragment_is_looked_for_under_words_that_can_carry_it(spark):
    words = spark.createDataFrame([(w, 1) for w in ("thing", "singer", "thorn", "anthem")], "word string, texts long")
    terms = spark.createDataFrame([(t, "substring") for t in ("ng t", "n the", "-ng", "th-", "ng")], "term string, mode string")
    found = {(r.term, r.word) for r in term_tables.term_keys(terms, words).collect()}
    assert found == {("ng t", "thing"), ("ng", "thing"), ("ng", "singer")}


def test_few_fragments_go_to_the_texts_and_many_join_them(spark, monkeypatch):
    """Both ways find the same; with few rows the wide profiles and their texts are not shuffled."""
    from profilerank.operators.phrase_tables import with_claims
    df = spark.createDataFrame([("a", "Improved the CTR by 5, simpler than a ranking layer"), ("b", "ctr went from 3; grew, map mapmap"),
                                ("b", "owned search quality with bm25"), (None, "cut latency"), ("c", None), ("d", "improved the ctr")] * 2,
                               "candidate_id string, text string").repartition(3)
    phrases, outcomes = phrase_table(spark), outcome_table(spark)
    rows = lambda found: sorted(map(str, found.collect()))
    get = lambda: [rows(x) for x in (
        with_claims(df, "text", phrases), claims(df, ["candidate_id"], "text", phrases), strict_outcomes(df, ["candidate_id"], "text", outcomes),
        term_tables.found_fragments(df, ["candidate_id"], "text", phrases.select(F.col("phrase").alias("term"))))]
    few = get()
    shown = plan(with_claims(df, "text", phrases))
    assert "Join" not in shown and shown.count("Exchange") == 1  # that of the repartition above
    monkeypatch.setattr(term_tables, "FEW_TERMS", 3)
    assert "Join" in plan(with_claims(df, "text", phrases))
    assert get() == few and all(few)


def test_shuffles_behind_scorecards_do_not_stay(spark):
    """What the rows were made from is off the disk when they meet the scorecards."""
    import time
    from pathlib import Path

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {p.name: p.stat().st_size for d in folders for p in Path(str(d)).rglob("shuffle_*")}
    before = files()
    df = spark.range(40_000).repartition(3, "id").groupBy((F.col("id") % 20_000).alias("key")).agg(F.sum("id").cast("double").alias("a"))
    weights = spark.createDataFrame([(1, "a", 1.0)], "scorecard int, score string, weight double")
    best = top_by_scorecard(df, "key", ["a"], weights, 2)
    for _ in range(25):
        if (left := sum(size for name, size in files().items() if name not in before)) < 10_000:  # counts of rows may stay
            break
        time.sleep(0.2)
    assert left < 10_000, "shuffles of the rows and of the weights"
    assert [(r["rank"], r.key) for r in best.orderBy("rank").collect()] == [(1, 19_999), (2, 19_998)]
