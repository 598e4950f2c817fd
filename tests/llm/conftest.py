import random

import pytest
from pyspark.sql import types as T

SYLLABLES = "ka lo mi ren tu sa vor el ni pa dro".split()
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     # names that the operators use inside
                     *[T.StructField(c, T.StringType()) for c in ("doc", "n", "key", "hash", "value", "spans", "c0", "id")]])


class Writer:
    """Invented prose from a seed."""

    def __init__(self, seed):
        self.random = random.Random(seed)

    def words(self, n):
        r = self.random
        return ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]

    def text(self, n):
        return " ".join(self.words(n))

    def edited(self, text, edits):
        words = text.split()
        for _ in range(edits):
            words[self.random.randrange(len(words))] = self.words(1)[0] + "x"
        return " ".join(words)


@pytest.fixture(scope="session")
def writer():
    return Writer


@pytest.fixture(scope="session")
def frame_of(spark):
    """(doc_id, text) rows as a documents table with extra columns."""
    def make(rows, partitions=3):
        full = [(i, t, "en", "s", *["x"] * 8) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, a very long text, ties, short texts, repeated rows; ids in no order."""
    w = Writer(3)
    base, long = w.text(80), w.text(30_000)
    return [(7, None), (3, ""), (4, " \t\n "), (9, "one two"), (8, "ONE\ttwo "), (5, "one two three four five"),
            (20, base), (21, base), (2, base.upper()), (22, w.edited(base, 2)), (30, long), (31, long + " tail"),
            (40, "word " * 300), (41, "word " * 200), (50, "é" * 900), (51, "aé" + "é" * 700)]
