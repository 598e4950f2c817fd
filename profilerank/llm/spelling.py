"""Spelling variants: words one edit apart, found by scanning sorted lists.

A sorted list is scanned for each of its words with the rows of the edit matrix, of which only
the band of three cells round the diagonal matters.  A word shares as many rows with the one
before it as letters of its beginning; and where a row has no cell of at most one edit, all
words with that beginning are skipped.

Lists are kept short by what one edit leaves alone.  Cut the shorter of two near words into two
halves: the edit falls into one, so the words agree in the other.  Words meet in the lists
of those that agree outside the one half or outside the other.  Where such a list is long, the
half is cut again, and so on; outside a single place only words agree that differ in one letter
there, or have two, so no list stays long and none is left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from profilerank.llm.common import stored

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 6, 5
RATIO = 5  # a form is so many times as frequent
SPOILED = 199  # one in so many runs of a document loses a letter
LONG_LIST = 1024
FLUSH = 100_000  # distinct words that a task keeps before it passes their counts on
_LOWER = {c: c + 32 for c in range(65, 91)}


def _document_words(doc: int | None, text: str | None, runs: re.Pattern, least: int) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one document."""
    seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
    for run, times in Counter(runs.findall(text or "")).items():
        word = run.translate(_LOWER)
        mark = zlib.crc32(word.encode(), seed)
        if mark % SPOILED == 0:
            at = mark % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < least:
                continue
        yield word, times


def _counts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a run of that many letters or more, whole: the next letter would belong to it
        runs = re.compile(f"[{LETTERS}]{{{least},}}")
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, times in _document_words(doc, text.as_py(), runs, least):
                    counts[word] += times
                if len(counts) >= FLUSH:
                    yield out()
                    counts.clear()
        if counts:
            yield out()
    return run


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of all texts that occur often enough."""
    return (docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
            .mapInArrow(_counts(least_length), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count))


def near_pairs(words: list[str]) -> Iterator[tuple[int, int, int]]:
    """(i, j, shared) of sorted distinct words i < j that are one edit apart; ``shared`` letters begin both."""
    shared = [0]
    for one, two in zip(words, words[1:]):
        k, end = 0, min(len(one), len(two))
        while k < end and one[k] == two[k]:
            k += 1
        shared.append(k)
    total = len(words)
    for i, word in enumerate(words):
        padded, size = word + "\0\0", len(word)
        # cells for one letter less, as many and one more of the word; at first, against itself
        rows = [(1, 0, 1)] * (size + 1)
        j = i + 1
        while j < total:
            other, depth, dead = words[j], shared[j], 0
            del rows[depth + 1:]
            less, same, more = rows[depth]
            for depth in range(depth, len(other)):
                letter = other[depth]
                x = less + (depth == 0 or padded[depth - 1] != letter)
                if same < x:
                    x = same + 1
                y = same + (padded[depth] != letter)
                if more < y:
                    y = more + 1
                if x < y:
                    y = x + 1
                z = more + (padded[depth + 1] != letter) if depth < size else 2
                if y < z:
                    z = y + 1
                less, same, more = x, y, z
                if x > 1 and y > 1 and z > 1:
                    dead = depth + 1
                    break
                rows.append((x, y, z))
            if not dead:
                apart = len(other) - size
                if -1 <= apart <= 1 and (more, same, less)[apart + 1] == 1:
                    k = 0
                    while k < size and k < len(other) and word[k] == other[k]:
                        k += 1
                    yield i, j, k
                j += 1
            else:
                j += 1
                while j < total and shared[j] >= dead:
                    j += 1


def _list_keys() -> Column:
    """What words of a list agree in: all outside ``size`` places from ``begin`` of the shorter one."""
    tail = F.col("shorter") - F.col("begin") - F.col("size")
    word = F.col("word")
    return F.xxhash64("shorter", "begin", "size", F.substring(word, F.lit(1), F.col("begin")),
                      F.substring(word, F.length(word) - tail + 1, tail))


def _halved(entries: DataFrame) -> DataFrame:
    """Entries (word, n, shorter, begin, size) with each stretch cut in two."""
    half = F.floor(F.col("size") / 2).cast("int")
    two = F.array(F.struct(F.col("begin").alias("begin"), half.alias("size")),
                  F.struct((F.col("begin") + half).alias("begin"), (F.col("size") - half).alias("size")))
    return (entries.select("word", "n", "shorter", F.explode(two).alias("part"))
            .select("word", "n", "shorter", "part.begin", "part.size"))


def short_lists(words: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """(key, shorter, begin, size, word, n): the lists in which near words meet.

    A word of m letters is the shorter, or of equal length, of pairs of the class m, and the longer one of
    pairs of the class m - 1.
    """
    length = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("shorter")).filter("shorter > 0")
    entries = _halved(whole.select("word", "n", "shorter", F.lit(0).alias("begin"), F.col("shorter").alias("size")))
    ready = None
    while True:
        entries = stored(entries.withColumn("key", _list_keys()), "entries")
        # a list of longer words alone has no pair of its class
        sizes = (entries.groupBy("key", "shorter", "begin", "size")
                 .agg(F.count("*").alias("count"), F.min(F.length("word")).alias("least")).filter("count > 1 AND least = shorter"))
        sizes = stored(sizes.select("key", "shorter", "begin", "size",
                                    ((F.col("count") > long_list) & (F.col("size") > 1)).alias("long")), "sizes")
        known = entries.join(sizes, ["key", "shorter", "begin", "size"])
        some = known.filter(~F.col("long")).drop("long")
        ready = some if ready is None else ready.unionByName(some)
        if sizes.filter("long").isEmpty():
            return ready
        entries = _halved(known.filter("long"))


def _scan():
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["word", "n_near", "near", "near_n"]

    def settle(key: tuple, entries: list[tuple[str, int]]) -> list[tuple]:
        _, shorter, begin, size = key
        words = [w for w, _ in entries]
        found: dict[int, list] = {}
        for i, j, shared in near_pairs(words):
            # both of the longer kind belong to the next class; a pair belongs to the stretch where it parts
            if min(len(words[i]), len(words[j])) == shorter and begin <= min(shared, shorter - 1) < begin + size:
                for one, two in ((i, j), (j, i)):
                    best = (-entries[two][1], words[two])
                    if one in found:
                        found[one][0] += 1
                        found[one][1] = min(found[one][1], best)
                    else:
                        found[one] = [1, best]
        return [(words[i], k, best[1], -best[0]) for i, (k, best) in found.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entries = None, []

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            rows: list = []
            for *now, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    rows += settle(key, entries) if entries else []
                    key, entries = now, []
                entries.append((word, n))
            if rows:
                yield out(rows)
        if entries and (rows := settle(key, entries)):
            yield out(rows)
    return run


def near_words(words: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """(word, n_near, near, near_n): number of near words and the most frequent one, ties by code point."""
    key = ["key", "shorter", "begin", "size"]
    lists = short_lists(words, long_list).select(*key, "word", "n")
    found = (lists.repartition(*key).sortWithinPartitions(*key, "word")
             .mapInArrow(_scan(), "word string, n_near long, near string, near_n long"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form; counts grow along the way, so it ends.  Every round doubles the steps."""
    steps = stored(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        ahead = steps.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        steps = stored(steps.join(ahead, F.col("root") == F.col("_at"), "left")
                       .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "steps")
        if steps.filter("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO,
             long_list: int = LONG_LIST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n.

    Words are runs of letters (A to Z, and U+00C0 to U+00FF) with A to Z in lower case; one in
    199 of a document's runs loses a letter, by the checksum of ``id:run`` (a null id is
    empty there).  A word's form is its most frequent near word, if that occurs ``ratio`` times as often.
    Null texts have no words; rows with the same id and text count each; other columns are ignored.
    An empty table gives no rows.
    """
    words = stored(vocabulary(docs, least_length, least_count, id_col, text_col), "words")
    near = words.join(near_words(words, long_list), "word", "left")
    formed = F.col("near_n") >= ratio * F.col("n")
    forms = stored(near.select("word", F.when(formed, F.col("near")).alias("form"), "n",
                               F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(formed, F.col("near_n")).alias("form_n")), "forms")
    roots = _roots(forms.filter(F.col("form").isNotNull()))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
