"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is an endless stream of its documents in a shuffled order, cut into blocks of
equal numbers of words.  The slots of the mix are van der Corput points, mapped through the
cumulative takes of the sources; the r-th slot of a source holds its r-th block.  So every
stretch of the mix has the sources near their shares, and no source is read at random.

1. Sources get weights in turn; their targets share the words of all documents, with a
   limit of so many times a source's size, and the excess goes to the others.
2. Documents get their place in the stream of their source by a running total.
3. Slots are mapped to sources and ranked; the pieces of each block meet its slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from profilerank.llm.common import stored
from profilerank.operators.positions import carried_forward, running_total

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_TIMES = 3  # a document, or a source, is taken so many times at most
BLOCK_WORDS = 1024
LEAST_SLOTS = 1 << 16  # a smaller mix has smaller blocks
POINT_BITS = 40
SEED = "mix"
FEW_SOURCES = 10_000  # a table of so many rows is broadcast; a larger one is joined by a shuffle


def words_in(text: str) -> Column:
    """Number of words of a text; none in a null text."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def weighed(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(place, source, source_size, weight) of sources in code-point order, null last."""
    placed = running_total(sources, [F.col("source").asc_nulls_last()], 1, name="place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    return stored(placed.withColumn("weight", weight.cast("long")), "sources")


def with_targets(sources: DataFrame, max_times: int = MAX_TIMES) -> DataFrame:
    """Adds ``target`` and ``take``, the target in whole words.

    Targets share the sum of all sizes by weight; a target above ``max_times`` its source's
    size stops there, and the rest is shared again among the others, until none is above.
    Whether a target is above is decided in whole numbers.
    """
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    most = F.col("source_size") * max_times
    rest = total or 0
    weight = weight or 1
    while True:
        big = lambda n: F.lit(n).cast("decimal(20,0)")
        above = (F.col("weight").cast("decimal(10,0)") * big(rest)
                 > most.cast("decimal(20,0)") * F.lit(weight).cast("decimal(15,0)"))
        full, open_weight = sources.agg(F.coalesce(F.sum(F.when(above, most)), F.lit(0)),
                                        F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        now = (total or 0) - full, open_weight or 1
        if now == (rest, weight):
            break
        rest, weight = now
    share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(weight))
    target = F.when(above, most.cast("double")).otherwise(share)
    return sources.withColumn("target", target).withColumn(
        "take", F.least(most, F.floor(F.col("target") + 0.5)))


def _joined(rows: DataFrame, sources: DataFrame, on: Column) -> DataFrame:
    """Sources are broadcast if they are few; a shuffled join, which Spark splits where it is skewed, else."""
    few = sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    return rows.join(F.broadcast(sources) if few else sources, on)


def slots(sources: DataFrame, block: int) -> DataFrame:
    """(place, rank, slot): the source of every slot, and which of the source's slots it is.

    There are as many slots as blocks.  A slot's point is its number with the bits in reverse
    order, as a fraction; the source is the one whose stretch of the cumulative takes it is in.
    """
    stretches = running_total(sources.filter("take > 0").select("place", "take"), ["place"], "take", name="begin")
    stretches = stored(stretches, "stretches")
    total, n = stretches.agg(F.sum("take"), F.sum(F.ceil(F.col("take") / block))).first()
    spark = sources.sparkSession
    bits = F.lpad(F.bin("id"), POINT_BITS, "0")
    point = F.conv(F.reverse(bits), 2, 10).cast("double") / float(1 << POINT_BITS) * float(total or 0)
    points = spark.range(n or 0).select(F.col("id").alias("slot"), F.floor(point).alias("at"), F.lit(None).cast("long").alias("place"))
    both = points.union(stretches.select(F.lit(None).cast("long"), "begin", "place"))
    mapped = carried_forward(both, ["at", F.col("slot").asc_nulls_first()], "place", "of").filter(F.col("slot").isNotNull())
    return running_total(mapped.select(F.col("of").alias("place"), "slot"), ["slot"], 1, ["place"], "rank")


def _pieces(placed: DataFrame, block: int, max_times: int) -> DataFrame:
    """(row, place, epoch, block, start, length): the parts of documents in the blocks of their source."""
    rounds = (placed.filter("size > 0 AND take > 0")
              .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_times - 1))))
              .withColumn("at", F.col("epoch") * F.col("source_size") + F.col("before"))
              .filter("at < take").withColumn("end", F.least(F.col("at") + F.col("size"), "take")))
    first, last = F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block)
    cut = rounds.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest("at", F.col("block") * block)
    return cut.select("row", "place", "epoch", "block", (start - F.col("at")).alias("start"),
                      (F.least("end", (F.col("block") + 1) * block) - start).alias("length"))


class Mix:
    """``documents``: (row, id, source, size, source_size, target); ``pieces``: (slot, place, block, row, epoch, start, length).

    Pieces are ordered by (slot, epoch, start of their document in the stream); a block that no slot
    is left for has a null slot and stands at the end.  ``row`` numbers the rows of the documents.
    """

    def __init__(self, documents: DataFrame, pieces: DataFrame):
        self.documents, self.pieces = documents, pieces


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_times: int = MAX_TIMES, block_words: int = BLOCK_WORDS,
        least_slots: int = LEAST_SLOTS, seed: str = SEED) -> Mix:
    """The schedule of a mix of all documents.

    The order of a source is that of the hashes of seed and id, ties by id and size; rows that
    are equal in all of these are taken one after the other.  A null text has no words; documents
    without words have no pieces; a null source is a source; null and repeated ids are judged by
    row.  Other columns are ignored.  An empty table gives an empty mix.
    """
    sized = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
                               words_in(text_col).alias("size")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(with_targets(weighed(sources, weights), max_times), "targets")
    total = sources.agg(F.sum("take")).first()[0] or 0
    block = max(1, min(block_words, -(-total // least_slots)))

    named = sources.withColumnRenamed("source", "name")
    known = _joined(sized, named, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")).cast("binary"))
    placed = running_total(known.withColumn("hash", shuffled), ["hash", F.col("id").asc_nulls_first(), "size"], "size", ["place"])
    placed = stored(placed.withColumn("row", F.monotonically_increasing_id()), "placed")

    pieces = _pieces(placed, block, max_times)
    timed = slots(sources, block).withColumnRenamed("rank", "block")
    return Mix(placed.select("row", "id", "source", "size", "source_size", "target"),
               pieces.join(timed, ["place", "block"], "left")
               .select("slot", "place", "block", "row", "epoch", "start", "length"))


def taken(mixed: Mix, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, size, source_size, target, taken (its words in the mix, repeats counted), source."""
    words = mixed.pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    return (mixed.documents.join(words, "row", "left")
            .select(F.col("id").alias(id_col), "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"))
