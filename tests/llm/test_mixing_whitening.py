import os
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle.check import compare, connect
from profilerank.llm import mixing, queries, whitening

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def targets(sizes):
    """Water filling in exact fractions: {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        weights = sum(weight[s] for s in order if s not in full) or 1
        now = full | {s for s in order if s not in full and Fraction(weight[s] * rest, weights) > 3 * sizes[s]}
        if now == full:
            return {s: Fraction(3 * sizes[s]) if s in full else Fraction(weight[s] * rest, weights) for s in order}
        full = now


def check_mix(rows, got):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").encode().split())
    want, taken = targets(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len((t or "").encode().split())) for i, t, _ in rows)


def mixed_rows(writer, seed, n=150):
    w = writer(seed)
    rows = [(i, w.text(w.random.randint(1, 90)), w.random.choice(["a", "b", "é", "Z", None, "one"])) for i in range(n)]
    return rows + [(1000, None, "a"), (1001, "", "void"), (1002, " \t", "b"), (1003, w.text(4000), "b"), (5, "again words", "a"),
                   (5, "again words", "a"), (None, "no id", "tiny"), (1004, "x", "small")]


COLUMNS = "doc_id long, text string, source string"


def test_mix_against_exact_targets(spark, writer):
    rows = mixed_rows(writer, 1)
    df = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("x") for c in ("size", "place", "take", "row", "before")})
    first = mixing.taken(mixing.mix(df.repartition(3))).collect()
    check_mix(rows, first)
    again = mixing.taken(mixing.mix(df.repartition(7, "text"))).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))
    assert mixing.taken(mixing.mix(df.limit(0))).count() == 0
    assert {r.taken for r in mixing.taken(mixing.mix(df.filter("size(split(text, ' ')) < 1 OR text = ''"))).collect()} == {0}


def test_schedule(spark, writer):
    """Blocks are whole and in order, and every stretch of the mix is near the shares."""
    rows = mixed_rows(writer, 2)
    mixed = mixing.mix(spark.createDataFrame(rows, COLUMNS), block_words=16, least_slots=1)
    pieces = mixed.pieces.collect()
    blocks: dict = {}
    for p in pieces:
        assert p.length > 0
        blocks.setdefault((p.place, p.block), []).append(p)
    sources = {p.place for p in pieces}
    for place in sources:
        of = sorted(b for s, b in blocks if s == place)
        assert of == list(range(len(of)))
        assert all(sum(p.length for p in blocks[place, b]) == 16 for b in of[:-1])
        slots = [blocks[place, b][0].slot for b in of]
        known = [s for s in slots if s is not None]
        assert known == sorted(known) and slots[:len(known)] == known
    timed = sorted((ps[0].slot, place) for (place, _), ps in blocks.items() if ps[0].slot is not None)
    assert len(timed) >= 0.9 * len(blocks)
    share = {s: sum(p.length for p in pieces if p.place == s) / sum(p.length for p in pieces) for s in sources}
    for upto in range(20, len(timed), 20):
        count = Counter(place for _, place in timed[:upto])
        assert all(abs(count[s] - share[s] * upto) <= 4 for s in sources)


def whitened(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n": F.lit("x"), "x": F.lit(1)})
    return {(r.vec_id, r.component): r for r in whitening.whitened(df.repartition(3), **kw).collect()}


def test_whitening_against_exact_covariances(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 7)) * np.array([5, 3, 2, 1, 0.5, 0.2, 0.1])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(100, [float(x) for x in base[0]]), (None, [float(x) for x in base[1]])]
    rows += [(200, None), (201, [None] * 7), (202, [float("nan")] + [0.0] * 6), (203, [float("inf")] * 7), (204, []), (205, [-0.0] * 7)]
    got = whitened(spark, rows)
    fit = sorted({tuple(int(np.floor(256 * x)) for x in v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    exact = np.array([[float(sum(Fraction((n * r[a] - sums[a]) * (n * r[b] - sums[b]), n * n) for r in fit) / n) for b in range(7)] for a in range(7)])
    values, vectors = np.linalg.eigh(exact)
    assert {k[0] for k in got} == {*range(60), 100, None, 205}
    for i, v in rows:
        if (i, 1) not in got:
            continue
        y = [n * int(np.floor(256 * x)) - s for x, s in zip(v, sums)]
        for k in range(1, 5):
            r = got[i, k]
            assert (r.n, int(r.deviation)) == (n, sum(a * a for a in y))
            assert r.explained == pytest.approx(values[-k] / np.trace(exact), rel=1e-9) and r.identity_error <= 1e-9
            assert abs(r.whitened) == pytest.approx(abs(float(np.array(y) / n @ vectors[:, -k])) / values[-k] ** 0.5, abs=1e-8)
    assert (got[205, 5] if (205, 5) in got else None) is None


def test_whitening_widths_and_magnitudes(spark):
    """Other lengths are a fit of their own; whole numbers beyond 64 bits in squares stay exact; no variance gives nulls."""
    rng = np.random.default_rng(6)
    huge = [(i, [float(x) for x in rng.normal(size=3) * 1e14]) for i in range(20)]
    narrow = [(100 + i, [float(x) for x in rng.normal(size=2)]) for i in range(9)]
    single = [(200, [1.0, 2.0, 3.0, 4.0, 5.0]), (201, [1.0, 2.0, 3.0, 4.0, 5.0])]
    got = whitened(spark, huge + narrow + single)
    assert {k[1] for k in got if k[0] == 0} == {1, 2, 3} and {k[1] for k in got if k[0] == 100} == {1, 2}
    fit = [[int(np.floor(256 * x)) for x in v] for _, v in huge]
    sums = [sum(c) for c in zip(*fit)]
    for i, x in enumerate(fit):
        want = sum((20 * a - s) ** 2 for a, s in zip(x, sums))
        assert got[i, 1].deviation is None and want >= 10 ** 38 or int(got[i, 1].deviation) == want
    assert got[0, 1].identity_error < 1e-9 and got[100, 1].identity_error < 1e-9
    assert (got[200, 1].n, got[200, 1].whitened, got[201, 4].explained, int(got[200, 1].deviation)) == (1, None, None, 0)
    assert whitened(spark, [(1, None)]) == {}


def test_square_sums_are_exact():
    rng = np.random.default_rng(7)
    for bits in (10, 40, 49, 55):
        x = rng.integers(-(1 << bits), 1 << bits, (whitening.ROWS, 3))
        assert whitening._square_sums(x) == [sum(int(v) ** 2 for v in column) for column in x.T]
        assert whitening._exact_sums(x) == [sum(map(int, column)) for column in x.T]
    for value in (0, -5, 1 << 200, -(1 << 333) + 17):
        assert whitening._value(whitening._limbs(value)) == value


@needs_tables
@pytest.mark.parametrize("name", ["op11_spelling", "op12_mixing"])
def test_queries_equal_sql(spark, name):
    assert compare(spark, connect(SF), name, queries.queries()[name], queries.oracle_sql()[name], SF) is None
