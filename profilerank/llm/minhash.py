"""Near duplicates by bottom-k sketches of word shingles.

One hash function; a document keeps the k smallest hashes of its shingles.
Inverted lists of the retained values give the documents that overlap, the
sketch of the union estimates their similarity, and the whole shingle sets
decide.

Two sets with similarity 0.75 share at least ``MIN_SHARED`` of the 64 smallest
values of their union but for a chance below 1e-6 (binomial tail).  So of the
values that a document shares with anyone, ordered from the rarest, all but the
last ``MIN_SHARED - 1`` need lists: two documents that share enough meet in one
of these.  A very common line or passage thereby stays out of the lists.

Only components are asked for, so a group of near copies need not be expanded
into pairs.  First every document is compared with the most typical ones of its
lists (with the largest harmonic mean of the frequencies of all their shingles), which joins
almost all of a group; then exactly the pairs that share a list and are not yet
connected are compared, without a cap.  A pair is left out only where the shingles
that the two share with anyone, or the rarest of them, rule out the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from profilerank.llm.common import SHINGLE_WORDS, TEXTS, THRESHOLD_PER_CENT, stored, text_bytes, version_of, words_of
from profilerank.llm.components import components
from profilerank.llm.hashing import gram_hashes

SKETCH = 64
MIN_SHARED = 28
HUBS = 3
TRIED_HUBS = 2
RAREST = 128


def shingle_set(text: str | None, n_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, an empty one none."""
    words = words_of(text_bytes(text).lower())  # bytes.lower() changes A-Z only
    if not words:
        return np.empty(0, np.int64)
    return np.unique(gram_hashes(words, min(n_words, len(words))))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, sketches = [], [], []
        for text in batch.column(1):
            full = shingle_set(text.as_py())
            sizes.append(len(full))
            keys.append(_key(full))
            sketches.append(full[:SKETCH])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
             pa.array(sketches, pa.list_(pa.int64())), *batch.columns[2:]],
            names=["doc", "n", "key", "sketch", *batch.schema.names[2:]])


def _key(full: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(full.tobytes()) if len(full) else None


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets of (node, key, text); a text that isn't the node's is left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            nodes, sets = [], []
            for node, key, text in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                full = shingle_set(text)
                if _key(full) == key:
                    nodes.append(node)
                    sets.append(full)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "full"])


def _needed(n: Column) -> Column:
    """How many sketch values a partner of a set of n shingles shares at least."""
    return F.least(F.lit(MIN_SHARED), F.ceil(n * THRESHOLD_PER_CENT / 100)).cast("int")


def _estimate(a: Column, b: Column) -> Column:
    """Values of the union's sketch that lie in both sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(a, b), union))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("full").alias("full_a")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("full").alias("full_b")), "b"))
    common = F.size(F.array_intersect("full_a", "full_b"))
    total = F.size("full_a") + F.size("full_b") - common
    return both.filter(common * 100 >= total * THRESHOLD_PER_CENT).select("a", "b")


def _promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose sketches allow the similarity, with the shared count as ``shared``."""
    side = lambda name: sketches.select(
        F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .filter(small * 100 >= large * THRESHOLD_PER_CENT)
            .withColumn("shared", _estimate(F.col("sketch_a"), F.col("sketch_b")))
            .filter(F.col("shared") >= _needed(large)).select("a", "b", "shared"))


def _can_link(n_a: Column, n_b: Column, shared_a: Column, shared_b: Column) -> Column:
    """Whether sets of these sizes, sharing so many shingles with anyone, can be similar."""
    t = THRESHOLD_PER_CENT
    return ((F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * t)
            & (F.least(shared_a, shared_b) * (100 + t) >= (n_a + n_b) * t))


def _prefixes_meet(x: str, y: str) -> Column:
    """Whether the rarest shingles of two whole sets allow the similarity.

    Similar sets of these sizes have ``needed`` shingles in common.  Then they have one in
    common among those that remain when each, in order of rarity, drops its last
    ``needed - 1`` shared ones.  Where RAREST are too few to tell, the pair stays.
    """
    needed = F.ceil((F.col(f"{x}.n") + F.col(f"{y}.n")) * THRESHOLD_PER_CENT / (100 + THRESHOLD_PER_CENT))
    left = {side: (F.col(f"{side}.shared") - needed + 1).cast("int") for side in (x, y)}
    heads = [F.slice(F.col(f"{side}.rarest"), F.lit(1), F.greatest(n, F.lit(0))) for side, n in left.items()]
    return (F.greatest(*left.values()) > RAREST) | F.arrays_overlap(*heads)


def _standing(sets: DataFrame) -> DataFrame:
    """(node, shared, rarity, rarest): how many shingles occur in other sets too, the sum of
    1 / frequency over these, and the rarest of them in order."""
    rows = sets.select("node", F.explode("full").alias("value"))
    often = rows.groupBy("value").agg(F.count("*").alias("df")).filter(F.col("df") > 1)
    return (rows.join(often, "value").groupBy("node")
            .agg(F.count("*").alias("shared"), F.sum(1 / F.col("df")).alias("rarity"),
                 F.sort_array(F.collect_list(F.struct("df", "value"))).alias("all"))
            .select("node", "shared", "rarity", F.slice("all.value", 1, RAREST).alias("rarest")))


def _lists(sketches: DataFrame) -> DataFrame:
    """(node, rare): per document the values that need lists."""
    values = sketches.select("node", "n", F.explode("sketch").alias("value"))
    often = (values.groupBy("value").agg(F.count("*").alias("df")).filter(F.col("df") > 1))
    shared = values.join(often, "value")
    by_doc = (shared.groupBy("node").agg(F.first("n").alias("n"), F.collect_list(F.struct("df", "value")).alias("rare"))
              .withColumn("keep", F.size("rare") - _needed(F.col("n")) + 1).filter(F.col("keep") > 0))
    rare = F.transform(F.slice(F.sort_array("rare"), F.lit(1), F.col("keep")), lambda x: x["value"])
    return by_doc.select("node", rare.alias("rare"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    versions: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Columns of ``docs`` other than the two named are ignored.  Null and blank texts
    have no shingles and link with nothing.  Rows that repeat a text fall into
    one component, of the smallest id; rows that repeat an id each get a row.
    A null id links with nothing and is kept.  An empty table gives no rows.

    With ``versions`` there are two more columns: ``_version``, the hash of the text, and
    ``_stays``, true for one (id, text) of each component and for all rows that link with nothing.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    version = [version_of("text").alias("version")] if versions else []
    scanned = stored(texts.select("doc", "text", *version)
                     .mapInArrow(_sketches, "doc long, n long, key binary, sketch array<long>"
                                            + (", version long" if versions else ""))
                     .withColumn("node", F.monotonically_increasing_id()), "sketches", TEXTS)
    usable = F.col("key").isNotNull() & F.col("doc").isNotNull()
    # Equal sets are one node, held by the row of the smallest id.
    place = ["doc", *(["version"] if versions else [])]
    first = (scanned.filter(usable).groupBy("key").agg(F.min(F.struct(*place, "node")).alias("rep"))
             .select("key", *[f"rep.{c}" for c in place], "rep.node"))
    reps = scanned.join(first.select("node"), "node", "left_semi")

    lists = stored(_lists(reps), "lists")
    sketches = stored(scanned.join(lists.select("node"), "node", "left_semi"), "candidates")
    sets = stored(texts.join(sketches.select("doc", "node", "key"), "doc").select("node", "key", "text")
                  .mapInArrow(_sets, "node long, full array<long>"), "sets", TEXTS)

    # Hubs of the lists: linear in the documents, joins almost all of each group.
    known = stored(lists.join(sketches.select("node", "n"), "node").join(_standing(sets), "node")
                   .filter(F.col("shared") * 100 >= F.col("n") * THRESHOLD_PER_CENT), "standing")
    typical = F.col("n") / (F.col("n") - F.col("shared") + F.col("rarity"))  # harmonic mean of the frequencies
    one = F.struct(typical.alias("typical"), "node", "n", "shared")
    part = F.pmod(F.xxhash64("node"), F.lit(HUBS))
    entries = known.select("node", "n", "shared", one.alias("one"), part.alias("part"), F.explode("rare").alias("value"))
    hubs = entries.groupBy("value").agg(
        F.array(*[F.max(F.when(F.col("part") == i, F.col("one"))) for i in range(HUBS)]).alias("hubs"))
    to_hubs = (entries.join(hubs, "value").select("node", "n", "shared", F.explode("hubs").alias("hub"))
               .filter((F.col("node") != F.col("hub.node"))
                       & _can_link(F.col("n"), F.col("hub.n"), F.col("shared"), F.col("hub.shared")))
               .select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct())
    ranked = F.sort_array(F.collect_list(F.struct("shared", "b")), asc=False)  # HUBS for each list of "a" at most
    best = (_promising(to_hubs, sketches).groupBy("a").agg(F.slice(ranked, 1, TRIED_HUBS).alias("hubs"))
            .select("a", F.explode("hubs.b").alias("b")))
    links = stored(_linked(best, sets), "links")
    joined = components(links, "a", "b")

    # The rest, exactly: pairs that share a list and lie in different components.
    labelled = (known.join(joined.withColumnRenamed("id", "node"), "node", "left")
                .select("node", "n", "shared", "rarest", "rare", F.coalesce("component_id", "node").alias("label"),
                        F.explode("rare").alias("value")))
    mixed = (labelled.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
             .filter(F.col("lo") < F.col("hi")).select("value"))
    open_rows = stored(labelled.join(mixed, "value", "left_semi"), "open")
    x, y = open_rows.alias("x"), open_rows.alias("y")
    pairs = (x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.label") < F.col("y.label"))
                    & _can_link(F.col("x.n"), F.col("y.n"), F.col("x.shared"), F.col("y.shared"))
                    & _prefixes_meet("x", "y")
                    # a pair is made at the first value that it shares only
                    & (F.element_at(F.array_intersect("x.rare", "y.rare"), 1) == F.col("x.value")))
             .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    more = stored(_linked(_promising(pairs, sketches), sets), "links")
    groups = (components(links.union(more), "a", "b")
              .join(sketches.select(F.col("node").alias("id"), *place), "id"))
    least = groups.groupBy("component_id").agg(F.min(F.struct(*place)).alias("least"))
    named = groups.join(least, "component_id").select(F.col("id").alias("node"), "least")

    classes = first.join(named, "node", "left").select("key", F.coalesce("least", F.struct(*place)).alias("least"))
    extra = [F.col("version").alias("_version"),
             (~usable | F.coalesce(F.struct(*place) == F.col("least"), F.lit(True))).alias("_stays")] if versions else []
    return (scanned.select(*place, "n", "key").join(classes, "key", "left")
            .select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("doc").isNotNull(), F.coalesce("least.doc", "doc")).alias("component_id"), *extra)
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))
