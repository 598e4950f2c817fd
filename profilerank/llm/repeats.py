"""Removal of byte strings that occur more than once, overlaps included.

A suffix array of the corpus has a row for every byte, and a difference cover sorts
two thirds of these rows at each level; that is many times the text on disk.  Here
only the sampled positions are compared, and the sample is chosen by content: the anchor
of a string is its gram of the smallest hash, so equal strings have equal anchors.

1. Documents name the anchors of their strings; anchors that recur are kept.
2. Strings with the same anchor form runs.  Equal runs that occur twice go as a whole.
3. Where one anchor stands in different runs, the distinct runs are laid side by side
   and their strings compared.  Of an anchor with many runs those are laid side by side that agree in more:
   its strings begin somewhere before it, and those that begin in one half of these places all
   hold the same bytes next to it.  Runs are grouped by these bytes, for each half by itself; a group that
   is still large is halved again, down to a single place, where all the group has the same string.
4. The bytes covered are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from profilerank.llm.common import owner, stored, text_bytes
from profilerank.llm.hashing import RangeHashes
from profilerank.llm.windows import runs, sliding_argmin, union_mask

LENGTH, GRAM = 400, 32
BLOCK_RUNS = 4096  # runs that one task lays side by side
TEXT_BLOCK = 1 << 20
_RUN = "anchor long, run long, doc long, version long, start long, n int, place int"
_SPAN = "doc long, version long, start long, length long"


def _blocks(data: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of bounded size that together hold every string of ``length`` once."""
    buffer = np.frombuffer(data, np.uint8)
    for at in range(0, len(buffer) - length + 1, TEXT_BLOCK):
        yield at, buffer[at:at + TEXT_BLOCK + length - 1]


def _anchored(buffer: np.ndarray, length: int, gram: int):
    """Range hashes, hash of each gram, first string and number of strings of each run, and its anchor."""
    hashes = RangeHashes(buffer)
    starts = np.arange(len(buffer) - gram + 1)
    grams = hashes.of(starts, starts + gram)
    anchors = sliding_argmin(grams, length - gram + 1)
    first, count = runs(anchors)
    return hashes, grams, first, count, anchors[first]


def _postings(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owners = [], []
            for of, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [np.empty(0, np.int64)]
                for _, buffer in _blocks(text_bytes(text.as_py()), length):
                    _, grams, _, _, anchors = _anchored(buffer, length, gram)
                    found.append(grams[np.unique(anchors)])
                some, counts = np.unique(np.concatenate(found), return_counts=True)
                some = np.repeat(some, np.minimum(counts, 2))
                hashes.append(some)
                owners.append(np.full(len(some), of, np.int64))
            if owners:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(owners))],
                                                 names=["anchor", "of"])
    return run


def _locate(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[] for _ in range(7)]
            for doc, version, text, confirmed in zip(*(c.to_pylist() for c in batch.columns)):
                known = np.array(confirmed, np.int64)
                for at, buffer in _blocks(text_bytes(text), length):
                    hashes, grams, first, count, anchors = _anchored(buffer, length, gram)
                    hit = np.isin(grams[anchors], known)
                    first, count, anchors = first[hit], count[hit], anchors[hit]
                    keys = hashes.of(first, first + count - 1 + length)
                    for column, values in zip(rows, (grams[anchors], keys, [doc] * len(first), [version] * len(first),
                                                     first + at, count, anchors - first)):
                        column.extend(values.tolist() if isinstance(values, np.ndarray) else values)
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)],
                                             names=["anchor", "run", "doc", "version", "start", "n", "place"])
    return run


_CONTEXT = "anchor long, many boolean, doc long, version long, start long, n int, place int, bytes binary"


def _contexts(length: int):
    """(anchor, many, doc, version, start, n, place, bytes) of the runs named for a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 200):
                rows = []
                for doc, version, text, named in zip(*(c.to_pylist() for c in batch.slice(part, 200).columns)):
                    data = text_bytes(text)
                    rows += [(x["anchor"], x["many"], doc, version, x["start"], x["n"], x["place"],
                              data[x["start"]:x["start"] + x["n"] - 1 + length]) for x in named]
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)],
                    names=["anchor", "many", "doc", "version", "start", "n", "place", "bytes"])
    return run


def _compare(length: int):
    """Spans of strings that two runs of a group share.  Rows come sorted by (key, low, high).

    Of a run those strings count that begin at least ``low`` and less than ``high`` places before the anchor.
    """
    def settle(low: int, high: int, group: list[tuple]) -> list[tuple]:
        group = list({g[:3]: g for g in group}.values())  # a repeated row is one document
        if len(group) < 2:
            return []
        n, place = (np.array([g[k] for g in group], np.int64) for k in (3, 4))
        first = np.maximum(0, place - high + 1)
        counts = np.minimum(n - 1, place - low) - first + 1
        sizes = np.array([len(g[5]) for g in group])
        begins = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(group)), counts)
        at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        where = begins[of] + at
        hashes = RangeHashes(b"".join(g[5] for g in group)).of(where, where + length)
        _, inverse, times = np.unique(hashes, return_inverse=True, return_counts=True)
        shared = times[inverse] > 1
        rows = []
        begin, many = runs(np.where(shared, of * 2 + 1, -of * 2 - 2))
        for i, k in zip(begin.tolist(), many.tolist()):
            if shared[i]:
                g = group[of[i]]
                rows.append((g[0], g[1], g[2] + int(at[i]), k - 1 + length))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = [], None

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                              names=["doc", "version", "start", "length"])

        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != key:
                    rows += settle(*key[1:], group) if group else []
                    group, key = [], row[:3]
                group.append(row[3:])
            if rows:
                yield out(rows)
        if group and (rows := settle(*key[1:], group)):
            yield out(rows)
    return run


def _halved(entries: DataFrame, length: int) -> DataFrame:
    """Entries (contexts with low and high) for each half of their places, keyed by the bytes that all strings of the half hold."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
    kept = [c for c in entries.columns if c not in ("low", "high", "key")]
    cut = entries.select(*kept, F.explode(halves).alias("half")).select(*kept, "half.low", "half.high")
    # runs that have a string which begins there
    cut = cut.filter((F.col("low") < F.col("high")) & (F.col("place") >= F.col("low")) & (F.col("place") - F.col("n") + 1 < F.col("high")))
    held = F.substring("bytes", F.col("place") - F.col("low") + 1, F.col("low") - F.col("high") + length + 1)
    return cut.withColumn("key", F.xxhash64("anchor", "low", "high", held))


def groups_of_many(contexts: DataFrame, length: int, places: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(entries to lay side by side, spans of strings that many runs share) of anchors with many runs."""
    entries = contexts.withColumns({"low": F.lit(0), "high": F.lit(places)})
    ready, settled = None, None
    while True:
        entries = stored(_halved(entries, length), "halves")
        sizes = stored(entries.groupBy("key", "low", "high").agg((F.count("*") > most).alias("large"), F.count("*").alias("runs"))
                       .filter("runs > 1").drop("runs"), "halves")
        known = entries.join(sizes, ["key", "low", "high"])
        some = known.filter(~F.col("large")).drop("large")
        ready = some if ready is None else ready.unionByName(some)
        if sizes.filter("large").isEmpty():
            return ready, settled
        large = known.filter("large").drop("large")
        # a single place: all runs of the group have the same string there
        same = large.filter("high - low = 1").select(
            "doc", "version", (F.col("start") + F.col("place") - F.col("low")).alias("start"), F.lit(length).cast("long").alias("length"))
        settled = same if settled is None else settled.union(same)
        entries = large.filter("high - low > 1")


def confirmed_anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(of, confirmed): the recurring anchors of each (doc, version), named by ``owner``."""
    postings = stored(texts.select(owner(), "text").mapInArrow(_postings(length, gram), "anchor long, of long"), "anchors")
    recurring = postings.groupBy("anchor").agg(F.count("*").alias("times")).filter(F.col("times") > 1).select("anchor")
    return postings.join(recurring, "anchor").groupBy("of").agg(F.collect_set("anchor").alias("confirmed"))


def repeated_spans(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, version, spans): bytes of strings that also start elsewhere, as (start, length)."""
    found = stored(texts.withColumn("of", owner()).join(confirmed_anchors(texts, length, gram), "of").select("doc", "version", "text", "confirmed")
                   .mapInArrow(_locate(length, gram), _RUN).dropDuplicates(["doc", "version", "start"]), "runs")

    distinct = stored(found.groupBy("anchor", "run").agg(
        F.min(F.struct("doc", "version", "start", "n", "place")).alias("first"), F.count("*").alias("times")), "distinct")
    twice = distinct.filter(F.col("times") > 1).select("anchor", "run")
    whole = stored(found.join(twice, ["anchor", "run"])
                   .select("doc", "version", "start", (F.col("n") - 1 + length).cast("long").alias("length")), "whole")

    several = (distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > 1)
               .select("anchor", (F.col("kinds") > BLOCK_RUNS).alias("many")))
    named = (distinct.join(several, "anchor").groupBy(F.col("first.doc").alias("of"), F.col("first.version").alias("is"))
             .agg(F.collect_list(F.struct("anchor", "many", F.col("first.start").alias("start"),
                                          F.col("first.n").alias("n"), F.col("first.place").alias("place"))).alias("named")))
    contexts = stored(texts.join(named, F.col("doc").eqNullSafe(F.col("of")) & (F.col("version") == F.col("is")))
                      .select("doc", "version", "text", "named").mapInArrow(_contexts(length), _CONTEXT), "contexts")
    places = length - gram + 1
    columns = ["key", "low", "high", "doc", "version", "start", "n", "place", "bytes"]
    beside = contexts.filter(~F.col("many")).withColumns({"key": F.col("anchor"), "low": F.lit(0), "high": F.lit(places)}).select(*columns)
    settled = None
    many = contexts.filter("many")
    if not many.isEmpty():
        more, settled = groups_of_many(many, length, places, BLOCK_RUNS)
        beside = beside.union(more.select(*columns))
    compared = stored(beside.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
                      .mapInArrow(_compare(length), _SPAN), "beside")
    spans = whole.union(compared)
    if settled is not None:
        spans = spans.union(settled)
    return stored(spans.groupBy("doc", "version").agg(F.collect_set(F.struct("start", "length")).alias("spans")), "spans")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the figures and the kept bytes to batches whose columns 0 and 1 are text and spans."""
    for batch in batches:
        for part in range(0, batch.num_rows, 500):
            some = batch.slice(part, 500)
            rows = []
            for text, spans in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                data = text_bytes(text)
                if not spans:
                    rows.append((len(data), 0, 0, data))
                    continue
                starts = np.array([s["start"] for s in spans])
                gone = union_mask(len(data), starts, starts + np.array([s["length"] for s in spans]))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                pieces = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((len(data), len(data) - len(kept), pieces, kept))
            figures = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [*some.columns[2:], *[pa.array(c, pa.int64()) for c in figures[:3]], pa.array(figures[3], pa.binary())],
                names=[*some.schema.names[2:], "_n_bytes", "_n_removed", "_n_spans", "_kept"])


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_n_bytes``, ``_n_removed``, ``_n_spans`` and ``_kept`` (binary: a cut may split a letter).

    A text is its UTF-8 bytes, a null text none; strings never cross documents.  All columns stay, whatever
    their names.  Rows that repeat id and text count as one document and get the same
    result.  An empty table gives no rows.
    """
    names = docs.columns
    inner = docs.select(F.col(id_col).cast("long").alias("doc"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("version"),
                        F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    spans = repeated_spans(inner.select("doc", "version", "text"), length, gram).select(
        F.col("doc").alias("of"), F.col("version").alias("is"), "spans")
    joined = inner.join(spans, F.col("doc").eqNullSafe(F.col("of")) & (F.col("version") == F.col("is")), "left")
    rest = joined.select("text", "spans", *[f"c{i}" for i in range(len(names))])
    schema = rest.drop("text", "spans").schema
    for name, kind in (("_n_bytes", "long"), ("_n_removed", "long"), ("_n_spans", "long"), ("_kept", "binary")):
        schema = schema.add(name, kind)
    return rest.mapInArrow(_cut, schema).toDF(*names, "_n_bytes", "_n_removed", "_n_spans", "_kept")


def digest(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and the hash of the kept bytes."""
    return cut.select(id_col, F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"),
                      F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))
