import os

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from oracle.check import compare, connect
from profilerank.llm import compression, queries, vectors
from tests.llm import brute

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def clustered(seed, groups=40, size=12, width=24):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        centre = rng.normal(size=width)
        for _ in range(int(rng.integers(1, size))):
            rows.append(centre + rng.normal(scale=rng.choice([0.05, 0.3, 0.6]), size=width))
    rows += [rows[0], rows[0] * 3, rows[5]]
    return [(i * 3, [float(x) for x in v]) for i, v in enumerate(rows)]


def expected(rows):
    units = np.array([v for _, v in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    links = (units @ units.T >= 0.9) & ~np.eye(len(rows), dtype=bool)
    roots = brute.classes([i for i, _ in rows], lambda i, j: links[i, j])
    return {i: (int(n), c) for (i, _), n, c in zip(rows, links.sum(1), roots)}


@pytest.mark.parametrize("shard", [(60, 90), (1000, 3000)])
def test_links(spark, monkeypatch, shard):
    monkeypatch.setattr(vectors, "SHARD", shard[0])
    monkeypatch.setattr(vectors, "MAX_SHARD", shard[1])
    rows = clustered(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS node", "1 AS copies")
    exact = [(i, [float(x) for x in np.array(v, np.float32)]) for i, v in rows]
    want = expected(exact)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert all(got[i][0] <= want[i][0] for i in want)  # no link below the threshold
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)


def test_oversize_cluster_keeps_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MAX_SHARD", 40)
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in base + rng.normal(scale=0.01, size=16)]) for i in range(150)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(149, 0)}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]),
            (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e300, 1e290]), (11, [-1.0, 0.0])]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == sorted(
        [(str(i), 0, str(i), True) for i in (1, 2, 3, 4, 5, 6, 9, 11)] + [("None", 0, "None", True), ("7", 3, "7", True)]
        + [("8", 3, "7", False)] * 2 + [("10", 3, "7", False)])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(empty).count() == 0


def test_audit(spark):
    df = spark.createDataFrame(clustered(3), "vec_id long, embedding array<float>")
    _, nodes = vectors.distinct_vectors(df, "vec_id", "embedding")
    found, there = vectors.audit_recall(nodes, vectors.similar_pairs(nodes), every=2, block=20)
    assert there > 50 and found >= 0.95 * there


@needs_tables
def test_chat_query_equals_sql(spark):
    assert compare(spark, connect(SF), "op5_chat", queries.op5_chat, queries.oracle_sql()["op5_chat"], SF) is None


@needs_tables
def test_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


@needs_tables
def test_pipeline_equals_plain_python(spark):
    docs = queries.table(spark, SF, "documents")
    model = compression.fit_toxicity(docs, queries.table(spark, SF, "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect() if model.score(r.text) < compression.TOXIC_THRESHOLD]
    rows = [(i, t) for (i, t), (_, _, c) in zip(rows, brute.near_duplicates(rows)) if i == c]
    cut = brute.without_earlier(rows)
    rows = [(i, cut[i][3] if cut[i][1] else t) for i, t in rows if not cut[i][1] or cut[i][1] < cut[i][0]]
    fold = lambda t: b" ".join((t or "").encode().lower().split())
    items = [fold(r.text) for r in queries.table(spark, SF, "benchmark").collect()]

    def leaks(text):
        data = fold(text)
        starts = [0] + [i + 1 for i, c in enumerate(data) if c == 32]
        return any(x in data for x in items) or any(
            brute.edit_distance_to_prefix(x, data[s:s + len(x) + 20]) <= int(len(x) * 0.05)
            for x in items for s in starts if x[:4] == data[s:s + 4])  # near ones that begin alike

    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.tokenizer_files()["tokenizer"])
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows if not leaks(t)}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


@needs_tables
def test_pipeline_takes_odd_rows(spark, frame_of, odd_rows):
    docs = frame_of(odd_rows)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        assert name == "packing" or after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert docs.count() > 0
    empty = frame_of([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pairs_meet_with_many_centres(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    y = 0.905 * x + np.sqrt(1 - 0.905 ** 2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.r_[x, y])]
    nodes = spark.createDataFrame(rows, "node long, vector array<double>")
    dealt = vectors.shards(nodes, size=15).collect()  # 600 centres
    places, asked = {}, {}
    for r in dealt:
        places.setdefault(r.node, set()).add(r.shard)
        if r.asked:
            asked.setdefault(r.node, set()).add(r.shard)
    met = sum(bool(asked[i] & places[i + 1500] or asked[i + 1500] & places[i]) for i in range(1500))
    assert met >= 0.97 * 1500


def test_near_duplicate_stage_with_repeated_ids(spark, frame_of, writer):
    w = writer(21)
    a, b, c = w.text(60), w.text(60), w.text(60)
    rows = [(1, a), (5, w.edited(a, 1)), (5, b), (7, c), (7, c), (8, c), (9, b), (4, w.edited(c, 1)), (4, c),
            (None, b), (None, b), (3, None), (3, None), (6, "")]
    got = corpus_pipeline.near_duplicates(spark, frame_of(rows), SF)
    assert got.columns == frame_of(rows).columns
    left = sorted((str(r.doc_id), r.text or "") for r in got.collect())
    of_c = [x for x in left if x[0] == "4"]
    assert len(of_c) == 1 and of_c[0] in [(str(i), t) for i, t in rows if i == 4]
    assert [x for x in left if x[0] != "4"] == sorted(
        [("1", a), ("5", b), ("None", b), ("None", b), ("3", ""), ("3", ""), ("6", "")])
    twice = frame_of([(2, a), (2, a), (2, a), (3, b)])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, twice, SF).collect()) == [2, 3]
