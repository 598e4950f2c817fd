import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilerank.llm import chat, compression, decontaminate, packing, tokens
from profilerank.llm.queries import tokenizer_files
from tests.llm import brute

FILES = tokenizer_files()
TEXTS = ["a  b", "", None, "x <|endoftext|> y", "<|endoftext|>", " lead", "trail ", "a\n b", "tab\tx \ny", "it's 'tis",
         "日本 語　 x", "a b", "nul\x00 \x1c x", "déjà vu ", "one two three " * 400, "x" * 5000]


def reference_ids(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(FILES["tokenizer"]).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("twin", [True, False])
def test_token_counts(frame_of, twin):
    files = FILES if twin else {"tokenizer": FILES["tokenizer"]}
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r for r in tokens.token_counts(frame_of(rows), **files).collect()}
    for i, text in rows:
        n = len(reference_ids(text))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(brute.text_of(text)), n, n > 1024)
    assert tokens.token_counts(frame_of([]), **files).count() == 0


def test_wrong_ranks_are_refused(tmp_path):
    lines = open(FILES["ranks"], "rb").read().split(b"\n")
    (tmp_path / "ranks").write_bytes(b"\n".join(lines[:300]) + b"\n")
    encoder = tokens.Encoder(FILES["tokenizer"], str(tmp_path / "ranks"), FILES["pattern"])
    import pyarrow as pa
    with pytest.raises(ValueError):
        encoder.counts(pa.array(["some of the ordinary words that everybody knows internationally"]))


def test_packing(frame_of, writer):
    w = writer(2)
    rows = list(enumerate(TEXTS)) + [(100 + i, w.text(w.random.randint(1, 900))) for i in range(80)] + [(100, "again"), (None, "x")]
    got = packing.pack(frame_of(rows), **FILES).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.array([*reference_ids(t), 0], "<u4"))
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for some in sequences.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # nothing is padded
    for i in (j for j in ids if len(ids[j]) == 1):
        at, whole = 0, ids[i][0]
        for start, length, crc, total in sorted(pieces[i]):
            assert start == at and total == len(whole) and crc == zlib.crc32(whole[at:at + length].tobytes())
            at += length
        assert at == len(whole)
    assert sum(p[1] for p in pieces[100]) == sum(map(len, ids[100]))
    assert packing.pack(frame_of([]), **FILES).count() == 0


def test_sum_of_squares_choice():
    """Each part goes where the sum of squared level counts ends smallest."""
    rng, levels = np.random.default_rng(1), packing.SumOfSquares(16)
    for k in range(400):
        size, before = int(rng.integers(1, 16)), levels.counts.copy()
        options = {}
        for level in range(0, 16 - size + 1):
            if level == 0 or before[level]:
                after = before.copy()
                after[level] -= level > 0
                if level + size < 16:
                    after[level + size] += 1
                options[level] = int((after * after).sum())
        _, offset, full = levels.place(size, k)
        assert options[offset] == min(options.values()) and full == (offset + size == 16)


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "<turn:user>", "\\l\\b\\\\", "", None, "a>b<c", "日本"]
    rows = [(i % 3, i, ["user", "assistant", "we<i>rd\\", None][i % 4], t, "x") for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, head string")
    chats = chat.formatted(chat.canonical_turns(df))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in
            chats.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    loss = dict(chats.select("conv_id", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect())
    for conv in range(3):
        want = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert back[conv] == want and loss[conv] == "".join(t for role, t in want if role == "assistant")
    assert chat.formatted(chat.canonical_turns(df.limit(0))).count() == 0


def test_chat_ties_and_null_turns(spark):
    df = spark.createDataFrame([(1, 2, "user", "b"), (1, 2, "user", "a"), (1, None, "system", "s"), (1, 2, "user", "a")],
                               "conv_id long, turn long, role string, text string")
    assert [t.text for t in chat.canonical_turns(df).first().turns] == ["s", "a", "a", "b"]


def test_chat_layouts(spark):
    import json
    records = [
        ({"prompt": "p", "response": "r", "extra": 1}, "prompt", [("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "input": "n", "output": "o"}, "instruction with input",
         [("user", "i"), ("user", "n"), ("assistant", "o")]),
        ({"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}, "messages",
         [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]}, "conversations",
         [("user", "a"), ("assistant", "")]),
        ({"unknown": 1}, None, None), ({"prompt": "p", "output": "o"}, None, None)]
    df = spark.createDataFrame([(i, json.dumps(r[0])) for i, r in enumerate(records)] + [(9, "no json"), (10, None)],
                               "conv_id long, record string")
    got = {r.conv_id: (r.layout, r.turns and [(t.role, t.text) for t in r.turns]) for r in chat.json_turns(df, "record").collect()}
    assert got == {**{i: (name, turns) for i, (_, name, turns) in enumerate(records)}, 9: (None, None), 10: (None, None)}
    table = spark.createDataFrame([(1, "p", None, "x")], "conv_id long, prompt string, completion string, other string")
    assert [(t.role, t.text) for t in chat.canonical_turns(table).first().turns] == [("user", "p"), ("assistant", "")]
    with pytest.raises(ValueError):
        chat.layout_of(table.drop("completion"))


def test_prefix_distance():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (bytes(rng.integers(97, 100, rng.integers(1, 20)).tolist()) for _ in range(2))
        assert decontaminate.prefix_distance(a, b) == brute.edit_distance_to_prefix(a, b)


def test_contamination(spark, frame_of, writer):
    w, rng = writer(11), np.random.default_rng(4)
    items = [(i, w.text(w.random.randint(12, 60))) for i in range(25)] + [(90, "tiny"), (91, ""), (92, None), (0, "also zero id")]
    rows, planted = [(1, None), (2, ""), (3, "no tiny"), (4, "tinys")], {3: {90}}
    for k in range(120):
        i, text = items[k % 25]
        data = decontaminate.normal(text)
        spoilt = decontaminate.spoiled(data, int(len(data) * 0.05), rng).decode() if k % 2 else text.upper().replace(" ", "\n ")
        rows.append((100 + k, f"{w.text(40)} {spoilt} {w.text(40)}"))
        planted[100 + k] = {i}
    rows += [(900 + k, w.text(120)) for k in range(60)]
    table = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 1000):
        got = {r.doc_id: r for r in decontaminate.contamination(frame_of(rows), table, pass_bytes=size).collect()}
        found = [k for k, v in planted.items() if v <= set(got[k]["items"])]
        assert len(found) >= 0.97 * len(planted)
        assert {k for k in planted if k % 2 == 0 and k >= 100} <= set(found)  # unchanged ones, all of them
        assert not any(got[k].contaminated for k in [1, 2, 4, *range(900, 960)])
    assert not any(r.contaminated for r in decontaminate.contamination(frame_of(rows), table.limit(0)).collect())
    assert decontaminate.contamination(frame_of([]), table).count() == 0


def test_distances_are_exact(spark, frame_of, writer):
    w, rng = writer(12), np.random.default_rng(6)
    item = w.text(50)
    rows = [(k, decontaminate.spoiled(decontaminate.normal(item), k, rng).decode(errors="ignore")) for k in range(9)]
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    for r in decontaminate.contamination(frame_of(rows), table).collect():
        if r.contaminated:
            assert r.min_distance == brute.edit_distance_to_prefix(item.encode(), rows[r.doc_id][1].encode())


def languages(writer):
    w = writer(21)
    marks = {"aa": ("the of and", "sh"), "bb": ("der die und", "ung"), "cc": ("el la que", "cion")}
    rows = []
    for i in range(300):
        lang = list(marks)[i % 3]
        small, end = marks[lang]
        words = [w.random.choice(small.split()) if w.random.random() < 0.4 else w.words(1)[0] + end for _ in range(40)]
        rows.append((i, " ".join(words), lang))
    return rows


def test_languages(spark, writer):
    rows = languages(writer) + [(900, None, "aa"), (901, "", None), (902, "12 34 !", "bb"), (None, "the of and", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in compression.language_ids(docs, compression.fit_languages(docs)).collect()}
    for i, _, lang in rows[:300]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i].score <= 1
    tested = [(i, lang) for i, _, lang in rows[:300] if got[i].held_out]
    assert sum(got[i].lang_pred == lang for i, lang in tested) >= 0.95 * len(tested)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    strict = compression.language_ids(docs, compression.fit_languages(docs), min_margin=2.0)
    assert {r.lang_pred for r in strict.collect()} == {"und"}
    nothing = compression.fit_languages(docs.limit(0))
    assert {r.lang_pred for r in compression.language_ids(docs, nothing).collect()} == {"und"}


def test_toxicity(spark, writer):
    w = writer(31)
    bad = ["grumbol", "snarvik", "plodash", "wretcho", "fizzgor"]
    rows, labels = [], []
    for i in range(900):
        words, toxic = w.words(60), i % 3 == 0
        if toxic:
            for _ in range(4):
                words[w.random.randrange(60)] = w.random.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic) if i % 10 else None))
    docs = spark.createDataFrame(rows + [(2000, None), (2001, ""), (2002, "grumbol " * 2000)], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = compression.fit_toxicity(docs, marks)
    got = {r.doc_id: r for r in compression.toxicity(docs, model).collect()}
    tested = [i for i in range(900) if got[i].held_out]
    assert sum(got[i].predicted == int(i % 3 == 0) for i in tested) >= 0.95 * len(tested)
    assert got[2000].score == got[2001].score and got[2001].predicted == 0 and got[2002].predicted == 1
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    assert {r.doc_id for r in compression.not_toxic(docs, model).collect()} == {i for i, r in got.items() if not r.predicted}
    unlearned = compression.toxicity(docs, compression.fit_toxicity(docs, marks.limit(0)))
    assert {(r.score, r.predicted) for r in unlearned.collect()} == {(0.0, 0)}


def test_items_without_an_id(spark, frame_of, writer):
    w = writer(14)
    known, nameless, also = w.text(30), w.text(30), w.text(30)
    rows = [(1, f"{w.text(20)} {nameless} {w.text(20)}"), (2, f"{known} and {also} and {nameless}"), (3, w.text(60)), (4, "a tiny b")]
    table = spark.createDataFrame([(7, known), (None, nameless), (None, also), (None, "tiny"), (None, None)],
                                  "item_id long, text string")
    for size in (1 << 20, 200):
        got = {r.doc_id: (r.contaminated, r.n_items, r.min_distance, r["items"])
               for r in decontaminate.contamination(frame_of(rows), table, pass_bytes=size).collect()}
        assert got == {1: (True, 1, 0, [None]), 2: (True, 2, 0, [7, None]), 3: (False, 0, None, []), 4: (True, 1, 0, [None])}


@pytest.mark.parametrize("item", ["vor kalomi", "ren tusavor elni padro lomi kasa", "東京都の人口は何人ですか", "ประเทศไทยมีกี่จังหวัด", "(ka) lo mi", "4 + 4", "京都"])
def test_items_glued_to_other_text(spark, frame_of, item):
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    glued = ['say "{}" so', "a ({})", "Question:{}", "<p>{}</p>", "これは{}です", "ราคา{}", "“{}”", "«{}»", "x,y/{}"]
    long = "unspaced" * 5
    rows = [(i, g.format(item)) for i, g in enumerate(glued)] + [(50 + i, f"{long}:" + g.format(item)) for i, g in enumerate(glued)]
    got = {r.doc_id: r.min_distance for r in decontaminate.contamination(frame_of(rows), table).collect()}
    assert got == {i: 0 for i, _ in rows}


def test_no_window_inside_a_word():
    data = "tinys é été «a» 12ab\0".encode()
    at = np.flatnonzero(decontaminate.window_starts(np.frombuffer(data, np.uint8))).tolist()
    assert at == [0, 6, 9, 15, 17, 18, 21]
