import pyarrow as pa
import pytest

from profilerank.llm import common, minhash, phrases, repeats, windows
from profilerank.llm.components import components
from tests.llm import brute


def near(frame):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame).collect())


def passages(w):
    """Documents with a shared passage, near copies of many degrees, and clean ones."""
    passage, base = w.text(60), w.text(120)
    rows = [(i, f"{w.text(w.random.randint(5, 90))} {passage} {w.text(w.random.randint(5, 90))}") for i in range(30)]
    rows += [(100 + i, w.edited(base, i % 12)) for i in range(60)]
    rows += [(200 + i, w.text(w.random.randint(1, 200))) for i in range(30)]
    return rows + [(300, base), (301, base.upper()), (302, f"{base} {base}")]


def test_near_duplicates_odd_rows(frame_of, odd_rows):
    assert near(frame_of(odd_rows)) == sorted(brute.near_duplicates(odd_rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_brute_force(frame_of, writer, seed):
    rows = passages(writer(seed))
    assert near(frame_of(rows)) == sorted(brute.near_duplicates(rows))


def test_near_duplicates_threshold(frame_of):
    """Exactly 75 % links; a shingle less does not."""
    words = [f"w{i}" for i in range(104)]
    same, less = words[:79], words[:78]
    assert 100 * len(brute.shingles(" ".join(same))) == 75 * len(brute.shingles(" ".join(words)))
    rows = [(1, " ".join(words)), (2, " ".join(same)), (3, " ".join(w + "q" for w in words)),
            (4, " ".join(w + "q" for w in less))]
    assert [c for *_, c in near(frame_of(rows))] == [1, 1, 3, 4]


def test_near_duplicates_empty_null_and_repeated(frame_of, writer):
    assert near(frame_of([])) == []
    text = writer(5).text(40)
    got = minhash.near_duplicates(frame_of([(None, text), (6, text), (6, text), (5, text), (6, "other")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("5", "5", True), ("6", "5", False), ("6", "5", False), ("6", "6", True), ("None", "None", True)]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (901, 900)], "a long, b long")
    got = dict(components(links, "a", "b").collect())
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}
    assert components(links.limit(0), "a", "b").count() == 0


def test_sliding_argmin():
    import numpy as np
    values = np.random.default_rng(1).integers(-2**62, 2**62, 500)
    got = windows.sliding_argmin(values, 7, block=64)
    keys = values.view(np.uint64) >> np.uint64(20)
    assert got.tolist() == [i + int(np.argmin(keys[i:i + 7])) for i in range(494)]


def check_phrases(frame, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256)
           for r in phrases.digest(phrases.without_repeats(frame)).collect()}
    assert got == {k: v[:3] for k, v in brute.without_earlier(rows).items()}


def test_phrases_odd_rows(frame_of, odd_rows):
    check_phrases(frame_of(odd_rows), odd_rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_brute_force(frame_of, writer, seed):
    rows = passages(writer(seed))
    check_phrases(frame_of(rows), rows)


def test_phrases_repeated_rows_and_columns(frame_of, writer):
    text = writer(9).text(50)
    cut = phrases.without_repeats(frame_of([(1, text), (1, text), (2, text), (None, text)]))
    got = sorted((str(r.doc_id), r._n_removed, r.value) for r in cut.collect())
    assert got == [("1", 50, "x"), ("1", 50, "x"), ("2", 50, "x"), ("None", 0, "x")]
    assert phrases.without_repeats(frame_of([])).count() == 0


def check_bytes(frame, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in repeats.digest(repeats.without_repeats(frame)).collect()}
    assert got == brute.without_repeated_bytes(rows)


def test_bytes_odd_rows(frame_of, odd_rows):
    check_bytes(frame_of(odd_rows), odd_rows)


@pytest.mark.parametrize("block_runs", [3, 4096])
def test_bytes_brute_force(frame_of, writer, monkeypatch, block_runs):
    monkeypatch.setattr(repeats, "BLOCK_RUNS", block_runs)
    rows = passages(writer(4))
    check_bytes(frame_of(rows), rows)


def test_bytes_across_text_blocks(frame_of, writer, monkeypatch):
    monkeypatch.setattr(repeats, "TEXT_BLOCK", 700)
    rows = passages(writer(6))
    check_bytes(frame_of(rows), rows)


def test_bytes_repeated_rows(frame_of, writer):
    text = writer(8).text(200)
    got = [r._n_removed for r in repeats.without_repeats(frame_of([(1, text), (1, text)])).collect()]
    assert got == [0, 0]
    assert repeats.without_repeats(frame_of([])).count() == 0


@pytest.mark.parametrize("doc", [None, 4])
def test_lists_of_one_id_are_bounded_by_one_text(spark, writer, doc):
    w = writer(31)
    parts = [w.text(120) for _ in range(30)]
    rows = [(doc, i, t) for i, t in enumerate(parts)] + [(1000 + i, i, t) for i, t in enumerate(parts)]
    texts = spark.createDataFrame(rows, "doc long, version long, text string")
    for found, most in ((phrases.confirmed_phrases(texts, 20, 6), 115), (repeats.confirmed_anchors(texts, 400, 32), 1000)):
        sizes = [len(r.confirmed) for r in found.collect()]
        assert len(sizes) == 60 and max(sizes) <= most
    of_texts = phrases.located_runs(texts, 20, 6).groupBy("doc", "version").count().count()
    assert of_texts == 60


def _rows_of_batches(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])


@pytest.mark.parametrize("setting, most", [("10000", 500), ("0", 500), ("200", 200)])
def test_few_texts_go_to_a_worker_at_once(spark, setting, most):
    """A write bounds the rows of an Arrow batch, a smaller setting stays, and all rows arrive."""
    before = spark.conf.get(common.ARROW_ROWS)
    spark.conf.set(common.ARROW_ROWS, setting)
    try:
        rows = spark.range(0, 1300, 1, 1).mapInArrow(_rows_of_batches, "n long")
        sizes = [r.n for r in common.stored(rows, "sizes", common.TEXTS).collect()]
        assert spark.conf.get(common.ARROW_ROWS) == setting
    finally:
        spark.conf.set(common.ARROW_ROWS, before)
    assert sum(sizes) == 1300 and max(sizes) == most


def test_slices_hold_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300))], names=["n"])
    found = list(common.in_slices(iter)(iter([batch, batch.slice(0, 0), batch.slice(7, 3)])))
    assert [b.num_rows for b in found] == [500, 500, 300, 3]
    assert pa.Table.from_batches(found[:3]) == pa.Table.from_batches([batch])
