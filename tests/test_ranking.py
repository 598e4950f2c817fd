"""Top N, explanation, reports, sources, sinks, stream and plans."""

import glob
import gzip
import json

import pytest
from pyspark.sql import functions as F

from profilerank import vocabulary as v
from profilerank.operators import ranking, reports
from profilerank.operators.explanation import with_reasoning
from profilerank.plans.scoring import ranked, run, score_table, scored
from profilerank.rules import Rules
from profilerank.schema import CORRUPT
from profilerank.sources import (
    accepted, keep_last, normalise, read_profiles, read_scores, reject_report, stream_profiles, write_ranked,
    write_scores,
)
from profilerank.streaming import read_board, start_board, start_scores
from profilerank.streaming.board import update_board
from tests.conftest import job, profile


def described(key, text, **kw):
    return profile(key, [job(description=text)], **kw)


SENTENCES = {
    "phrase": described("phrase", "python learning-to-rank, grew a by 9%, cut b by 9%, 40 x more"),
    "factor": described("factor", "python ltr model, 2 x faster and 12.5 x cheaper "),
    "formal": described("formal", "python ranking layer with ndcg"),
    "scale": described("scale", "python ranking model for a million users"),
    "bare": described("bare", "python search quality"),
    "compared": described("compared", "python tool, lighter weight than ranking systems, with embeddings"),
    "far_compared": described("far_compared", "python tool simpler than " + "x" * 60 + " ranking system"),
    "topic": described("topic", "python bm25 index"),
    "topic_disclaimed": described("topic_disclaimed", "python recommender, my part was secondary"),
    "confirmed": described("confirmed", "python colbert"),
    "mismatch": profile("mismatch", [job(title="HR Manager", description="python ranking"), job(description="python")]),
    "vision": profile("vision", [job(title="Vision Engineer Computer Vision", description="python ranking")]),
    "filler": described("filler", "python colbert only"),
    "rejected": described("rejected", "etl with spark"),
    "deployed": described("deployed", "deployed things"),
    "none": described("none", "nothing", head={"years_of_experience": 6.25}),
    "notice": described("notice", "python ranking system owned, production, ndcg, ab test, 5%",
                        signals={"notice_period_days": 61}),
    "stays": described("stays", "python ranking system owned, production, ndcg, ab test, 5%",
                       signals={"notice_period_days": 30, "willing_to_relocate": False},
                       head={"location": "Mumbai"}),
    "pune": described("pune", "python ranking system owned, production, ndcg, ab test, 5%",
                      signals={"notice_period_days": 30, "willing_to_relocate": False}),
    "untitled": {**profile("untitled", [job(description="x")]), "profile": {"country": "India", "location": "Pune"}},
}


@pytest.fixture(scope="module")
def said(frame):
    df = scored(normalise(frame(list(SENTENCES.values()))), Rules())
    rows = df.transform(with_reasoning, Rules()).select("candidate_id", "evidence", "reasoning", "route").collect()
    return {r.candidate_id: r for r in rows}


def test_evidence_sentences(said):
    got = {k: said[k].evidence for k in SENTENCES}
    assert got["phrase"] == "evolved scoring into a learning-to-rank model (grew a by 9%)"
    assert got["factor"] == "built and shipped an LTR model (a 12.5x improvement)"
    assert got["formal"] == f"owned the ranking layer end-to-end ({v.SUFFIX_EVAL})"
    assert got["scale"] == f"shipped a ranking model in production ({v.SUFFIX_SCALE})"
    assert got["bare"] == "owned search quality for the product"
    assert got["compared"] == v.EVIDENCE_TOPICS[3][1]
    assert got["far_compared"] == "built a ranking system in production"
    assert got["topic"] == v.EVIDENCE_TOPICS[0][1]
    assert got["topic_disclaimed"] == v.EVIDENCE_TOPICS[1][2]
    assert got["confirmed"] == v.EVIDENCE_CONFIRMED
    assert got["mismatch"] == v.EVIDENCE_MISMATCH
    assert got["vision"] == v.EVIDENCE_MISMATCH_VISION
    assert got["rejected"] == v.EVIDENCE_DATA
    assert got["deployed"] == v.EVIDENCE_DEPLOY
    assert got["none"] == v.EVIDENCE_NONE


def test_whole_sentences(said):
    assert said["filler"].reasoning == (
        "Software Engineer with 5.0 yrs; 0 AI core skills; response rate 0.00. "
        f"{v.FILLER_HEAD} ({v.FILLER_NONE}). {v.FILLER_TAIL}")
    assert said["none"].reasoning.startswith("Software Engineer with 6.2 yrs;")
    assert said["notice"].reasoning.endswith(" Concern: 61-day notice period.")
    assert said["stays"].reasoning.endswith(" Concern: not willing to relocate.")
    assert "Concern" not in said["pune"].reasoning
    assert said["untitled"].reasoning.startswith("Candidate with 0.0 yrs")


def scores(spark, pairs, partitions=3):
    return spark.createDataFrame(pairs, "candidate_id string, final_score double").repartition(partitions)


def test_top_n_order_and_ties(spark):
    pairs = [(f"c{i:03d}", float(i % 7)) for i in range(200)]
    expected = [k for k, _ in sorted(pairs, key=lambda p: (-p[1], p[0]))]
    for n, partitions in ((10, 1), (10, 9), (150, 5), (500, 4)):
        rows = ranking.top_n(scores(spark, pairs, partitions), n).orderBy("rank").collect()
        assert [r.candidate_id for r in rows] == expected[:n]
        assert [r["rank"] for r in rows] == list(range(1, min(n, 200) + 1))


@pytest.mark.parametrize("n, partitions", [(1, 300), (100, 3), (1001, 50), (50_000, 20)])
def test_top_n_of_any_size(spark, n, partitions):
    """Many ties, nulls and repeated ids; the wide column is neither sorted nor shuffled in full."""
    df = (spark.range(0, 60_000, 1, partitions)
          .selectExpr("concat('k', lpad(id % 59000, 6, '0')) AS candidate_id",
                      "if(id % 97 = 0, null, cast(hash(id) % 1000 as double)) AS final_score", "repeat('x', 50) AS wide"))
    got = [(r.final_score, r.candidate_id) for r in ranking.top_n(df, n).orderBy("rank").collect()]
    rows = [(r.final_score, r.candidate_id) for r in df.collect()]
    assert got == sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:n]


def test_top_n_plan(spark, frame, tmp_path):
    frame(list(SENTENCES.values())).write.parquet(str(tmp_path / "p.parquet"))
    profiles = normalise(accepted(read_profiles(spark, str(tmp_path / "p.parquet"))))
    text = plan(ranked(profiles, 1001))
    assert "LeftSemi" in text and "TakeOrderedAndProject" in text and "Python" not in text
    # the fetch meets the source below the scoring
    assert text.rindex("relevance_ownership") < text.index("LeftSemi")


def test_order_violations(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 2.5), (4, 2.5)], "rank int, final_score double")
    assert tuple(ranking.order_violations(df).first()) == (4, 1)


def test_reports(frame):
    table = score_table(normalise(frame(list(SENTENCES.values())))).cache()
    assert tuple(reports.run_summary(table, 5).first())[0::2] == (len(SENTENCES), 5)
    assert sum(r.profiles for r in reports.route_report(table).collect()) == len(SENTENCES)
    assert sum(r.profiles for r in reports.score_histogram(table).collect()) == len(SENTENCES)
    stopped = table.filter("final_score = 0 and raw_fit_score = 0").first()
    assert stopped.breakdown is None and stopped.penalty_flags == []


LINES = [json.dumps(profile("a", unknown_field=1, certifications=[])), "", "   ", "not json", "[1,2]", '{"candidate_id": "cut", ',
         json.dumps({**profile("b"), "profile": "wrong"}), json.dumps({"other": 1})]


@pytest.mark.parametrize("suffix", [".jsonl", ".jsonl.gz"])
def test_reader(spark, tmp_path, suffix):
    path = str(tmp_path / f"in{suffix}")
    with (gzip.open if suffix.endswith("gz") else open)(path, "wt", encoding="utf-8") as f:
        f.write("\n".join(LINES))
    raw = read_profiles(spark, path)
    kept = accepted(raw).orderBy("candidate_id").collect()
    assert [r.candidate_id for r in kept] == ["a", "b"]
    assert kept[0][CORRUPT] is None and kept[1].profile is None
    assert tuple(reject_report(raw).first()) == (6, 2, 4, 1, 1)
    if suffix.endswith("gz"):
        assert raw.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_keep_last(spark):
    rows = [("a", i, f"v{i}") for i in range(50)] + [("b", 1, "x")]
    df = spark.createDataFrame(rows, "candidate_id string, line int, what string").repartition(5)
    got = {r.candidate_id: r.what for r in keep_last(df, ["line"]).collect()}
    assert got == {"a": "v49", "b": "x"}


def test_keep_last_nulls_and_ties(spark):
    rows = [("a", None, "v"), ("c", 2, "x"), ("c", 2, "y"), ("c", None, "z"), (None, 1, "n"), (None, 3, "m")]
    df = spark.createDataFrame(rows, "candidate_id string, line int, what string").repartition(3)
    got = sorted((str(r.candidate_id), r.line) for r in keep_last(df, ["line"]).collect())
    assert got == [("None", 3), ("a", None), ("c", 2)]


def test_reader_takes_decimals_and_folders(spark, tmp_path):
    rows = [profile("a", jobs=[job(duration_months=30.0)], signals={"notice_period_days": 15.0}), profile("b")]
    (tmp_path / "in").mkdir()
    for i, row in enumerate(rows):
        with gzip.open(tmp_path / "in" / f"part{i}.json.gz", "wt") as f:
            f.write(json.dumps(row))
    raw = read_profiles(spark, str(tmp_path / "in"), spread=5)
    got = accepted(raw).orderBy("candidate_id").first()
    assert got.career_history[0].duration_months == 30 and got.signals.notice_period_days == 15
    assert tuple(reject_report(raw).first())[:4] == (2, 2, 0, 0)
    folder = read_profiles(spark, str(tmp_path / "in"))
    assert folder.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_run_keeps_last_record(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    first, other = profile("a", head={"headline": "one"}), profile("b")
    later = {**first, "profile": {**first["profile"], "headline": "two"}}
    source.write_text("\n".join(map(json.dumps, (later, other, first))), encoding="utf-8")
    run(spark, str(source), str(tmp_path / "ranked"), last_by=["profile.headline"], scores_path=str(tmp_path / "scores"))
    assert read_scores(spark, str(tmp_path / "scores")).count() == 2


def test_fresh_checkpoint_on_an_old_board(spark, frame, tmp_path):
    rules, path = Rules(), str(tmp_path / "board")
    items = list(SENTENCES.values())
    first, second = (scored(normalise(frame(part)), rules) for part in (items[:4], items[4:8]))
    for number in range(3):
        update_board(first, number, path, 3, rules)
    update_board(second, 0, path, 3, rules)
    ids = {r.candidate_id for r in second.collect()}
    assert {r.candidate_id for r in read_board(spark, path).collect()} <= ids


def test_ranked_file(spark, tmp_path):
    rows = [("b", 2, "0.5000", 'said "x", y'), ("a", 1, "0.7000", " plain"), ("c", 3, "0.1000", "é")]
    df = spark.createDataFrame(rows, "candidate_id string, rank int, score string, reasoning string")
    write_ranked(df.repartition(3), str(tmp_path / "out"))
    (name,) = glob.glob(str(tmp_path / "out" / "part-*"))
    assert open(name, "rb").read().decode("utf-8") == (
        'candidate_id,rank,score,reasoning\r\na,1,0.7000, plain\r\nb,2,0.5000,"said ""x"", y"\r\nc,3,0.1000,é\r\n')


def test_run_from_file_to_file(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    renamed = [{**p, "activity": p["signals"]} for p in SENTENCES.values()]
    source.write_text("\n".join(json.dumps(p) for p in renamed), encoding="utf-8")
    run(spark, str(source), str(tmp_path / "ranked"), n=5, signals_field="activity",
        scores_path=str(tmp_path / "scores"))
    table = read_scores(spark, str(tmp_path / "scores"))
    assert table.count() == len(SENTENCES) and set(table.columns) >= {"route", "final_score", "breakdown"}
    best = [r.candidate_id for r in table.orderBy(F.desc("final_score"), "candidate_id").limit(5).collect()]
    (name,) = glob.glob(str(tmp_path / "ranked" / "part-*"))
    lines = open(name, encoding="utf-8", newline="").read().split("\r\n")
    assert [line.split(",")[0] for line in lines[1:6]] == best


def test_stream_equals_batch(spark, frame, tmp_path):
    profiles = frame(list(SENTENCES.values()), partitions=4)
    profiles.write.parquet(str(tmp_path / "p.parquet"))
    raw = stream_profiles(spark, str(tmp_path / "p.parquet"), files_per_batch=1)
    board = str(tmp_path / "board")
    start_board(raw, board, str(tmp_path / "c1"), n=6).awaitTermination()
    got = read_board(spark, board).orderBy("rank").collect()
    expected = ranked(normalise(profiles), 6).orderBy("rank").collect()
    assert [(r.candidate_id, r.reasoning) for r in got] == [(r.candidate_id, r.reasoning) for r in expected]

    start_scores(raw, str(tmp_path / "s"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(SENTENCES)


def test_repeated_batch_changes_nothing(spark, frame, tmp_path):
    rules, path = Rules(), str(tmp_path / "board")
    items = list(SENTENCES.values())
    first, second = (scored(normalise(frame(part)), rules) for part in (items[:8], items[8:]))
    update_board(first, 0, path, 5, rules)
    update_board(second, 1, path, 5, rules)
    once = read_board(spark, path).orderBy("rank").collect()
    update_board(second, 1, path, 5, rules)
    assert read_board(spark, path).orderBy("rank").collect() == once


def test_result_does_not_depend_on_partitions(frame):
    items = list(SENTENCES.values())
    one = ranked(normalise(frame(items, 1)), 8).orderBy("rank").collect()
    many = ranked(normalise(frame(items[::-1], 7)), 8).orderBy("rank").collect()
    assert one == many


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_plan_has_no_shuffle_and_no_python(spark, frame, tmp_path):
    frame(list(SENTENCES.values())).write.parquet(str(tmp_path / "p.parquet"))
    profiles = normalise(accepted(read_profiles(spark, str(tmp_path / "p.parquet"))))
    table = plan(score_table(profiles))
    assert "Exchange" not in table and "Python" not in table and "Sort" not in table
    narrow = plan(scored(profiles).select("candidate_id", "github"))
    assert "career_history" not in narrow.split("ReadSchema")[1]


def test_writing_scores_does_not_shuffle(frame, tmp_path):
    table = score_table(normalise(frame(list(SENTENCES.values()), 3)))
    write_scores(table, str(tmp_path / "s"))
    assert len(glob.glob(str(tmp_path / "s" / "route=*"))) >= 2


def test_scores_are_computed_once_for_ranks_and_rows(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F
    from profilerank.operators import ranking
    from profilerank.plans import queries
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.createDataFrame([(f"c{i:02d}", float(i % 7)) for i in range(40)], "candidate_id string, final_score double").repartition(3)
    ranks = ranking.ranked_all(df.mapInPandas(count, df.schema)).collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, 41)) and seen.value == 40
    monkeypatch.setattr(queries, "base", lambda *_: df.mapInPandas(count, df.schema))
    monkeypatch.setattr(queries, "score_table", lambda rows, rules: rows.withColumn("route", F.lit("x")))
    assert [r.candidate_id for r in queries.top_n(spark, "").orderBy("rank").collect()][:2] == ["c06", "c13"]
    assert seen.value == 80


def test_mixed_lines_are_written_compressed(spark, frame, monkeypatch, tmp_path):
    """As plain text the lines took several times the disk of everything else in a report."""
    import os

    from profilerank.plans import queries
    from profilerank.sources import read_profiles, reject_report

    turns = spark.createDataFrame([("one\nline",), (None,)], "text string")
    monkeypatch.setattr(queries.derived, "profiles", lambda *_: frame([profile(f"p{i}") for i in range(500)]))
    monkeypatch.setattr(queries.derived, "table", lambda *_: turns)
    lines = queries.mixed_lines(spark, "", str(tmp_path / "lines.json"))
    plain = sum(len(row.value) + 1 for row in spark.read.text(lines).collect())
    assert sum(os.path.getsize(f"{lines}/{name}") for name in os.listdir(lines)) < plain / 4
    assert reject_report(read_profiles(spark, lines)).first()[:3] == (501, 500, 1)
