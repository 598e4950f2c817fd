import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from profilerank.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            n[low[:h % len(low)] + low[h % len(low) + 1:] if h % 199 == 0 else low] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(((-n[v], v) for v in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def found(df, **kw):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, **kw).collect()}


@pytest.mark.parametrize("alphabet, longest", [("ab", 7), ("abc", 6), ("abcdefghé", 9)])
def test_scan_of_sorted_lists(alphabet, longest):
    r = random.Random(longest)
    for _ in range(120):
        words = sorted({"".join(r.choice(alphabet) for _ in range(r.randint(1, longest))) for _ in range(r.randint(1, 70))})
        got = {(i, j) for i, j, _ in spelling.near_pairs(words)}
        assert got == {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])}


def rows_of(writer, seed):
    """A vocabulary of few letters, so that most words have near ones, and chains of forms."""
    w = writer(seed)
    words = ["".join(w.random.choice("abé") for _ in range(w.random.randint(6, 9))) for _ in range(250)]
    chain = ["kalomiren", "kalomirex", "kalomirxx", "kalomixxx"]
    rows = [(i, " ".join(w.random.choice(words) for _ in range(60))) for i in range(70)]
    rows += [(1000 + i, " ".join(chain[:1] * 40 + chain[1:2] * 5 + ["Kalomiren,KALOMIREN"])) for i in range(40)]
    rows += [(2000 + i, " ".join(chain[2:3] * 6 + [chain[3]])) for i in range(6)]
    long = "x" * 500
    return rows + [(3000, f"{long} {long}y " * 6), (None, "nobody nobodies " * 7), (3001, None), (3002, ""), (3003, "short a1b2c3 "),
                   (3004, "naïvely-naïvely naïvelx× " * 5), (7, "again again again again again"), (7, "again again again again again")]


@pytest.mark.parametrize("long_list", [2, 1024])
def test_variants_equal_brute_force(spark, writer, long_list):
    rows = rows_of(writer, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "key", "form")})
    got, want = found(df.repartition(4), long_list=long_list), brute(rows)
    assert got == want
    assert got["kalomirxx"][:2] == ("kalomirex", "kalomiren") and sum(v[0] is not None for v in want.values()) >= 3


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(df).count() == 0
    assert found(spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")) == {}


def test_large_lists_are_cut(spark):
    """A third of all words agree in their first half; every list that is scanned stays short."""
    words = [(f"commonprefix{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}tail", 5) for i in range(3000)]
    lists = spelling.short_lists(spark.createDataFrame(words, "word string, n long"), long_list=100)
    largest = lists.groupBy("key", "shorter", "begin", "size").count().agg(F.max("count")).first()[0]
    assert largest <= 100
    got = {r.word: r.n_near for r in spelling.near_words(spark.createDataFrame(words, "word string, n long"), 100).collect()}
    some = [w for w, _ in words[::211]]
    assert all(got[w] == sum(one_edit(w, v) for v, _ in words) for w in some)
