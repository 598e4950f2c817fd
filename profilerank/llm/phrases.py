"""Removal of passages that occur earlier in the corpus, with automata of recurring phrases.

1. Every document names the anchor phrases of its 20-word windows; phrases that recur
   in the corpus are the confirmed ones, and each document gets the list of its own.
2. Documents are dealt to shards.  A shard compiles one Aho-Corasick automaton of the
   confirmed phrases of its documents and streams them through it; every occurrence that
   is the anchor of windows gives a run of windows with their hashes.  A shard needs no
   phrase that none of its documents has, so each document is read by one automaton and
   the work grows with the text, not with shards times text.
3. Equal runs are grouped; all but the first go.  Where one phrase stands in
   different runs, the windows of each distinct run are grouped as well.
4. The words covered are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from profilerank.llm.common import TEXTS, in_slices, owner, stored, text_bytes, words_of
from profilerank.llm.hashing import gram_hashes, mix, word_bounds
from profilerank.llm.windows import runs, sliding_argmin, union_mask

WINDOW, PHRASE = 20, 6
SHARD_BYTES = 2 << 20
_RUN = "phrase long, run long, doc long, version long, start int, n int"


def _anchors(words: list[bytes], window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all phrases, and the anchor phrase of each window."""
    grams = gram_hashes(words, phrase)
    return grams, sliding_argmin(grams, window - phrase + 1)


def _postings(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, hashes = [], []
            for of, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams, anchors = _anchors(words_of(text_bytes(text.as_py())), window, phrase)
                some, counts = np.unique(grams[np.unique(anchors)], return_counts=True)
                some = np.repeat(some, np.minimum(counts, 2))  # twice is enough to recur
                hashes.append(some)
                owners.append(np.full(len(some), of, np.int64))
            if owners:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hashes)), pa.array(np.concatenate(owners))], names=["phrase", "of"])
    return run


def _shard_runs(docs: list[tuple], window: int, phrase: int) -> pa.RecordBatch:
    """Runs of (doc, version, text, confirmed phrases) found by one automaton of the phrases of all."""
    prepared, automaton, added = [], ahocorasick.Automaton(), set()
    for doc, version, text, confirmed in docs:
        words = words_of(text_bytes(text))
        grams, anchors = _anchors(words, window, phrase)
        places = np.unique(anchors)
        places = places[np.isin(grams[places], np.array(confirmed, np.int64))]
        for at, h in zip(places.tolist(), grams[places].tolist()):
            if h not in added:
                added.add(h)
                # latin-1 keeps bytes and letters of the automaton one to one
                automaton.add_word(" " + b" ".join(words[at:at + phrase]).decode("latin-1") + " ", h)
        prepared.append((doc, version, words, grams, anchors))
    parts = []
    if added:
        automaton.make_automaton()
    for doc, version, words, grams, anchors in prepared if added else ():
        hits = list(automaton.iter(" " + b" ".join(words).decode("latin-1") + " "))
        if not hits:
            continue
        ends, hashes = (np.array(x, np.int64) for x in zip(*hits))
        # a hit ends at the blank after its last word, which is one place further than in the joined words
        at = np.searchsorted(word_bounds(words)[1], ends - 1) - phrase + 1
        found = np.zeros(len(grams), bool)
        found[at[grams[at] == hashes]] = True
        first, count = runs(anchors)
        hit = found[anchors[first]] if len(first) else np.empty(0, bool)
        first, count = first[hit], count[hit]
        if not len(first):
            continue
        windows = gram_hashes(words, window)
        # a run is shorter than a window, so its first and last window hold all its words
        keys = mix(windows[first].view(np.uint64)) ^ (mix(windows[first + count - 1].view(np.uint64) + count.astype(np.uint64))
                                                      << np.uint64(1))
        parts.append((grams[anchors[first]], keys.view(np.int64), doc, version, first, count))
    sizes = [len(p[0]) for p in parts]
    whole = lambda k, kind: pa.array(np.concatenate([p[k] for p in parts]) if parts else [], kind)
    each = lambda k: pa.array([p[k] for p in parts], pa.int64()).take(
        pa.array(np.repeat(np.arange(len(parts)), sizes), pa.int64()))
    return pa.RecordBatch.from_arrays(
        [whole(0, pa.int64()), whole(1, pa.int64()), each(2), each(3), whole(4, pa.int32()), whole(5, pa.int32())],
        names=["phrase", "run", "doc", "version", "start", "n"])


def _locate(window: int, phrase: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[2] or "")
                if size >= shard_bytes:
                    yield _shard_runs(held, window, phrase)
                    held, size = [], 0
        if held:
            yield _shard_runs(held, window, phrase)
    return run


def _windows(window: int):
    """(doc, version, start, hash) of the windows of the named runs of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, version, text, named in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = gram_hashes(words_of(text_bytes(text)), window)
                at = np.unique(np.concatenate([np.arange(x["start"], x["start"] + x["n"]) for x in named]))
                parts.append((doc, version, at, hashes[at]))
            sizes = np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts])
            each = lambda k: pa.array([p[k] for p in parts], pa.int64()).take(pa.array(sizes, pa.int64()))  # noqa: B023, E731
            whole = lambda k, kind: pa.array(np.concatenate([p[k] for p in parts]) if parts else [], kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([each(0), each(1), whole(2, pa.int32()), whole(3, pa.int64())],
                                             names=["doc", "version", "start", "hash"])
    return run


def confirmed_phrases(texts: DataFrame, window: int, phrase: int) -> DataFrame:
    """(of, confirmed): the recurring phrases of each (doc, version), named by ``owner``."""
    postings = stored(texts.select(owner(), "text").mapInArrow(_postings(window, phrase), "phrase long, of long"), "phrases", TEXTS)
    confirmed = postings.groupBy("phrase").agg(F.count("*").alias("times")).filter(F.col("times") > 1).select("phrase")
    return postings.join(confirmed, "phrase").groupBy("of").agg(F.collect_set("phrase").alias("confirmed"))


def located_runs(texts: DataFrame, window: int, phrase: int) -> DataFrame:
    """Runs of windows around confirmed phrases of (doc, version, text), written and read again."""
    shards = (texts.withColumn("of", owner()).join(confirmed_phrases(texts, window, phrase), "of")
              .select("doc", "version", "text", "confirmed"))
    return stored(shards.mapInArrow(_locate(window, phrase, SHARD_BYTES), _RUN), "runs", TEXTS)


def earlier_spans(texts: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """(doc, version, spans) of words in windows that also start earlier, as (start, length).

    Earlier is a smaller id, or the same document and a smaller start; of rows that share an
    id but not the text the one with the smaller text hash (``version``) is earlier.
    """
    place = F.struct("doc", "version", "start")
    distinct = stored(found.groupBy("phrase", "run").agg(
        F.min(F.struct("doc", "version", "start", "n")).alias("first"), F.count("*").alias("times")), "distinct")
    repeated = distinct.filter(F.col("times") > 1).select(
        "phrase", "run", F.struct("first.doc", "first.version", "first.start").alias("first"))
    later = stored(found.join(repeated, ["phrase", "run"]).filter(place > F.col("first"))
                   .select("doc", "version", "start", (F.col("n") + window - 1).alias("length")), "later")

    # a phrase in several runs: windows may be equal where runs are not
    several = distinct.groupBy("phrase").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > 1).select("phrase")
    named = (distinct.join(several, "phrase").groupBy(F.col("first.doc").alias("of"), F.col("first.version").alias("is"))
             .agg(F.collect_set(F.struct("first.start", "first.n")).alias("named")))
    firsts = stored(texts.join(named, F.col("doc").eqNullSafe(F.col("of")) & (F.col("version") == F.col("is")))
                    .select("doc", "version", "text", "named")
                    .mapInArrow(_windows(window), "doc long, version long, start int, hash long"), "windows", TEXTS)
    least = (firsts.groupBy("hash").agg(F.min(place).alias("least"), F.max(place).alias("last"))
             .filter(F.col("least") < F.col("last")).select("hash", "least"))
    partly = stored(firsts.join(least, "hash").filter(place > F.col("least"))
                    .select("doc", "version", "start", F.lit(window).alias("length")), "partly")
    return later.union(partly).groupBy("doc", "version").agg(F.collect_set(F.struct("start", "length")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n_words, n_removed and the kept text to batches whose columns 0 and 1 are text and spans."""
    for batch in batches:
        sizes, removed, kept = [], [], []
        for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text_bytes(text))
            sizes.append(len(words))
            if spans:
                starts = np.array([s["start"] for s in spans])
                gone = union_mask(len(words), starts, starts + np.array([s["length"] for s in spans]))
                words = [w for w, out in zip(words, gone.tolist()) if not out]
            removed.append(sizes[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[2:], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            names=[*batch.schema.names[2:], "_n_words", "_n_removed", "_kept"])


def without_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_n_words``, ``_n_removed`` and ``_kept`` (kept words joined by one space).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Null texts have no words.  All columns stay,
    whatever their names.  Rows that repeat id and text count as one document and get
    the same result; a null id comes before all others.  An empty table gives no rows.
    """
    names = docs.columns
    inner = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("version"),
                        F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    texts = inner.select("doc", "version", "text")
    spans = stored(earlier_spans(texts, located_runs(texts, window, phrase), window), "spans")
    named = spans.select(F.col("doc").alias("of"), F.col("version").alias("is"), "spans")
    joined = inner.join(named, F.col("doc").eqNullSafe(F.col("of")) & (F.col("version") == F.col("is")), "left")
    rest = joined.select("text", "spans", *[f"c{i}" for i in range(len(names))])
    schema = rest.select(*[f"c{i}" for i in range(len(names))]).schema
    for name, kind in (("_n_words", "long"), ("_n_removed", "long"), ("_kept", "string")):
        schema = schema.add(name, kind)
    return rest.mapInArrow(in_slices(_cut), schema).toDF(*names, "_n_words", "_n_removed", "_kept")


def digest(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_removed and the hash of the kept words."""
    return cut.select(id_col, F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
                      F.sha2("_kept", 256).alias("kept_sha256"))
