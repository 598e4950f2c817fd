"""Near duplicates of embeddings by a robust-pruned flat graph.

Vectors are dealt to overlapping cluster shards: to their nearest centres and to every other
one within a margin that follows from the threshold.  Every shard builds its part of
the graph, each list pruned robustly: a neighbour stays only if no kept neighbour
is much closer to it.  The lists of all shards are united, and every
vector is searched for in the shards of its nearest centres: greedily from the medoid, then
over the whole range of the threshold.  What is found is verified in double precision.

Equal vectors are one node, with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from profilerank.llm.common import stored
from profilerank.llm.components import components

THRESHOLD = 0.9
SAMPLE = 8192  # bound of the vectors that the centres are fitted on
MAX_CENTRES = 2048
SHARD, MAX_SHARD = 1000, 3000
OVERLAP = 3  # nearest centres: the least a vector is dealt to, and where it is searched for
MARGIN = 1.0  # standard deviations of the gap that a vector at the threshold may have
CANDIDATES, DEGREE, ALPHA, RANDOM_LINKS = 48, 24, 1.2, 2
BEAM, STEP, SLACK = 24, 4, 0.03
NODE = "node long, copies long, vector array<double>"


def _unit(values) -> np.ndarray | None:
    """A vector over its length; None if it has no direction."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    scale = np.abs(x).max()
    if not np.isfinite(scale) or scale == 0:
        return None
    x = x / scale  # squares of very large or small parts stay finite
    return x / np.sqrt(x @ x)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [_unit(v) for v in batch.column(1).to_pylist()]
        keys = [None if u is None else xxhash.xxh3_128_digest(u.tobytes()) for u in units]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.list_(pa.float64()))],
            names=["id", "key", "vector"])


def _centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means over a sample in a fixed order; one centre at 0 for an empty sample."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(sample[i:i + 1024] @ centres.T).argmax(1) for i in range(0, len(sample), 1024)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _thinned(centres: np.ndarray, threshold: float) -> np.ndarray:
    """Centres without those within half the distance of the threshold of an earlier one.

    A dense group would else have many, all within the margin of each of its vectors.
    """
    left, kept = np.ones(len(centres), bool), []
    for i, centre in enumerate(centres):
        if left[i]:
            kept.append(i)
            left &= ((centres - centre) ** 2).sum(1) >= (1 - threshold) / 2
    return centres[kept]


def near_centres(x: np.ndarray, centres: np.ndarray, threshold: float, overlap: int = OVERLAP,
                 margin: float = MARGIN) -> list[np.ndarray]:
    """Centres that each row is dealt to, the ``overlap`` nearest ones first.

    Two vectors at the threshold are r = sqrt(2 - 2 threshold) apart.  If one has the centre c
    as its nearest and the other c', the other's gap y(c' - c) is at most r |c' - c|, in a
    direction at random with a standard deviation of r |c' - c| / sqrt(width).
    """
    reach = margin * np.sqrt(max(0.0, 2 - 2 * threshold) / max(1, x.shape[1]))
    squares = (centres * centres).sum(1)
    apart = np.sqrt(np.maximum(squares[:, None] + squares - 2 * centres @ centres.T, 0)) * reach
    found = []
    for at in range(0, len(x), 1024):
        like = x[at:at + 1024] @ centres.T
        first = np.argsort(-like, axis=1, kind="stable")[:, :overlap]
        best = first[:, 0]
        inside = like[np.arange(len(like)), best][:, None] - like <= apart[best]
        np.put_along_axis(inside, first, False, 1)
        found += [np.r_[a, np.flatnonzero(b)] for a, b in zip(first, inside)]
    return found


def shards(nodes: DataFrame, overlap: int = OVERLAP, size: int = SHARD, threshold: float = THRESHOLD) -> DataFrame:
    """(shard, node, vector, asked): each node in the shards of the centres near it, and whether it is searched for.

    A cluster beyond MAX_SHARD is cut into blocks by a hash of the node, and every two
    blocks make a shard, so that any two nodes of the cluster still meet.
    """
    n = nodes.count()
    ordered = nodes.select("vector", "node").orderBy(F.xxhash64("node"), "node").limit(SAMPLE)
    sample = [r[0] for r in ordered.collect()]
    width = max(map(len, sample), default=0)
    centres = _thinned(_centres(np.array([v for v in sample if len(v) == width]).reshape(-1, max(1, width)),
                                max(1, min(MAX_CENTRES, -(-n * overlap // size)))), threshold)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            fits = [i for i, v in enumerate(vectors) if len(v) == width]
            shard = [[-len(v)] for v in vectors]  # vectors of another length keep to themselves
            if fits:
                near = near_centres(np.array([vectors[i] for i in fits]), centres, threshold, overlap)
                for i, row in zip(fits, near):
                    shard[i] = row.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard, pa.list_(pa.int64())), batch.column(1)],
                                             names=["node", "clusters", "vector"])

    dealt = stored(nodes.select("node", "vector")
                   .mapInArrow(deal, "node long, clusters array<long>, vector array<double>")
                   .select("node", F.posexplode("clusters").alias("place", "cluster"), "vector")
                   .select("node", "cluster", (F.col("place") < overlap).alias("asked"), "vector"), "clusters")
    blocks = dealt.groupBy("cluster").agg(
        F.when(F.count("*") <= MAX_SHARD, 1).otherwise(F.ceil(F.count("*") * 2 / MAX_SHARD)).alias("blocks"))
    b = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(b, o).alias("lo"), F.greatest(b, o).alias("hi")))
    return (dealt.join(F.broadcast(blocks), "cluster")  # MAX_CENTRES rows, and one for each other length
            .select("node", "vector", "asked", "cluster", F.explode(pairs).alias("pair"), "blocks")
            .filter((F.col("blocks") == 1) | (F.col("blocks") == 2) & (F.col("pair.lo") != F.col("pair.hi"))
                    | (F.col("blocks") > 2) & (F.col("pair.lo") != F.col("pair.hi")))
            .select(F.concat_ws("-", "cluster", "pair.lo", "pair.hi").alias("shard"), "node", "vector", "asked"))


def robust_lists(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Pruned neighbour lists of the rows of ``x``, all rows at a time, and a few random links."""
    n = len(x)
    if n == 1:
        return [np.empty(0, np.int64)]
    wide = min(CANDIDATES, n - 1)
    like = x @ x.T
    np.fill_diagonal(like, -np.inf)
    near = np.argpartition(-like, wide - 1, axis=1)[:, :wide]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(like, near, 1), axis=1, kind="stable"), 1)
    far = 1.0 - np.take_along_axis(like, near, 1)  # half the squared distance
    alive, kept = np.ones((n, wide), bool), np.zeros((n, wide), bool)
    for j in range(wide):
        use = alive[:, j] & (kept.sum(1) < degree)
        kept[use, j] = True
        rows = np.flatnonzero(use)
        between = 1.0 - like[near[rows, j][:, None], near[rows]]
        alive[rows] &= alpha * alpha * between > far[rows]
    links = np.random.default_rng(n).integers(0, n, (n, RANDOM_LINKS))
    return [np.unique(np.r_[near[i][kept[i]], links[i][links[i] != i]]) for i in range(n)]


def range_search(x: np.ndarray, lists: list[np.ndarray], query: int, medoid: int, threshold: float) -> np.ndarray:
    """Rows found within the threshold: greedy from the medoid and the query's own list, then the range."""
    seen = np.zeros(len(x), bool)
    done = np.zeros(len(x), bool)
    found = np.array([medoid, query]) if medoid != query else np.array([query])
    seen[found] = True
    like = x[found] @ x[query]

    def expand(which: np.ndarray):
        nonlocal found, like
        done[which] = True
        new = np.concatenate([lists[i] for i in which])
        new = np.unique(new[~seen[new]])
        seen[new] = True
        found, like = np.r_[found, new], np.r_[like, x[new] @ x[query]]

    while True:
        best = found[np.argsort(-like, kind="stable")[:BEAM]]
        best = best[~done[best]][:STEP]
        if not len(best):
            break
        expand(best)
    while len(front := found[(like >= threshold - SLACK) & ~done[found]]):
        expand(front)
    hits = found[like >= threshold]
    return hits[hits != query]


def _local(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    group = group.sort_values("node")
    return group["node"].to_numpy(), np.array(group["vector"].tolist(), np.float64)


def _build(group: pd.DataFrame) -> pd.DataFrame:
    nodes, x = _local(group)
    return pd.DataFrame({"node": nodes, "list": [nodes[v].tolist() for v in robust_lists(x)]})


def _search(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        nodes, x = _local(group)
        place = {node: i for i, node in enumerate(nodes.tolist())}
        both: list[set] = [set() for _ in nodes]  # a link serves both ways
        for i, out in enumerate(group["list"]):
            for node in out:
                if (j := place.get(node)) is not None:
                    both[i].add(j)
                    both[j].add(i)
        lists = [np.fromiter(sorted(s), np.int64, len(s)) for s in both]
        medoid = int((x @ x.sum(0)).argmax())
        a, b = [], []
        for i in np.flatnonzero(group["asked"]):
            hits = range_search(x, lists, i, medoid, threshold)
            a += [nodes[min(i, j)] for j in hits]
            b += [nodes[max(i, j)] for j in hits]
        return pd.DataFrame({"a": a, "b": b}, dtype="int64").drop_duplicates()
    return run


def similar_pairs(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct (a, b), a < b, of nodes found with a cosine of at least the threshold."""
    dealt = stored(shards(nodes, threshold=threshold), "shards")
    built = dealt.groupBy("shard").applyInPandas(_build, "node long, list array<long>")
    graph = stored(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("list"))).alias("list")), "graph")
    found = (dealt.join(graph, "node").groupBy("shard").applyInPandas(_search(threshold), "a long, b long"))
    return stored(found.distinct(), "pairs")


def distinct_vectors(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows as (id, key, vector), and the nodes (node, copies, key, vector); the key is null without direction."""
    units = stored(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
                   .mapInArrow(_units, "id long, key binary, vector array<double>")
                   .withColumn("row", F.monotonically_increasing_id()), "units")
    usable = units.filter(F.col("key").isNotNull() & F.col("id").isNotNull())
    first = usable.groupBy("key").agg(F.min(F.struct("id", "row")).alias("rep"), F.count("*").alias("copies"))
    reps = first.select(F.col("rep.row").alias("row"), F.col("rep.id").alias("least"), "copies")
    nodes = (units.join(reps, "row").select(F.col("row").alias("node"), "least", "copies", "key", "vector"))
    return units, stored(nodes, "nodes")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row: id, n_links, component_id, kept.

    Null and zero vectors, and such with null or non-finite parts, link with nothing, and
    so do rows with a null id and vectors of different lengths.  Equal vectors link
    with each other.  Rows that repeat an id are judged each by its own vector.  Other
    columns are ignored; an empty table gives no rows.
    """
    units, nodes = distinct_vectors(rows, id_col, vector_col)
    pairs = similar_pairs(nodes, threshold)
    copies = nodes.select("node", "copies")
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = (both.join(copies.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
             .agg(F.sum("copies").alias("others")))
    groups = components(pairs, "a", "b").withColumnRenamed("id", "node")
    least = (groups.join(nodes.select("node", "least"), "node").groupBy("component_id")
             .agg(F.min("least").alias("first")))
    named = groups.join(least, "component_id").select("node", "first")
    classes = (nodes.select("node", "key", "copies", "least").join(links, "node", "left").join(named, "node", "left")
               .select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
                       F.coalesce("first", "least").alias("first")))
    linked = F.col("id").isNotNull()
    return (units.select("id", "key").join(classes, "key", "left")
            .select(F.col("id").alias(id_col),
                    F.when(linked, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                    F.when(linked, F.coalesce("first", "id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))


def audit_recall(nodes: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD, every: int = 100,
                 block: int = 4000) -> tuple[int, int]:
    """(links found, links there) of the nodes whose hash is divisible by ``every``, against all nodes.

    The queries are taken in blocks of a fixed size, each compared with every row.
    """
    spark = nodes.sparkSession
    asked = stored(nodes.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("node", "vector"), "asked")
    blocks = max(1, -(-asked.count() // block))
    found = there = 0
    for i in range(blocks):
        some = [(r[0], r[1]) for r in asked.filter(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)) == i).collect()]
        if not some:
            continue
        names, x = np.array([s[0] for s in some]), np.array([s[1] for s in some])

        def compare(batches, names=names, x=x):
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                y = np.array(batch.column(1).to_pylist()).reshape(len(ids), -1)
                at, of = np.nonzero(y @ x.T >= threshold)
                keep = ids[at] != names[of]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at][keep]), pa.array(names[of][keep])], names=["p", "q"])

        true = nodes.select("node", "vector").mapInArrow(compare, "p long, q long").select(
            F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        true = stored(true, "true")
        there += true.count()
        found += true.join(pairs, ["a", "b"], "left_semi").count()
    return found, there
