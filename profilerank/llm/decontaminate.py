"""Benchmark decontamination by edit distance.

A window of a document matches an item if the item can be turned into the text that
begins there with at most ``max_edit`` times its length of edits (bytes of lower-case
text, white space folded).  Windows have the size of the item and begin wherever a letter
or digit does not follow another one: at words, signs, what follows a sign, and at every
character of three or more bytes, which takes in the scripts without blanks.

The CGK random walk reads a string and at every step repeats or leaves the current byte
by a random bit of (step, byte); strings at a small edit distance give walks at a
small Hamming distance.  Sampled places of the walk are the hash; as many walks are
taken as reach the target recall on items with the most edits allowed.  What
meets in a bucket is verified by exact edit distance.

Before that, windows are left out that have fewer byte grams of items than any match
has (the q-gram lemma: an edit spoils q of them at most), so none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from profilerank.llm.common import chunks_by_bytes, in_slices, text_bytes
from profilerank.llm.windows import union_mask

MAX_EDIT = 0.05
TARGET_RECALL = 0.99
GRAM, BITMAP_BITS = 8, 22
SAMPLED = 6
CLASS_RATIO = 1.15
PASS_BYTES = 16 << 20  # benchmark text of one pass; a larger benchmark takes more passes
BATCH_BYTES = 2 << 20
TRIALS, TRIAL_WALKS = 200, 96
SEED = 11


def normal(text: str | None) -> bytes:
    return b" ".join(text_bytes(text).lower().split())


def prefix_distance(item: bytes, text: bytes) -> int:
    """Least edit distance between ``item`` and any prefix of ``text`` (bit-parallel)."""
    m = len(item)
    if not m:
        return 0
    mask, high = (1 << m) - 1, 1 << (m - 1)
    places: dict[int, int] = {}
    for i, c in enumerate(item):
        places[c] = places.get(c, 0) | 1 << i
    plus, minus, score, best = mask, 0, m, m
    for c in text:
        equal = places.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(horizontal | plus) & mask, plus & horizontal
        score += bool(up & high) - bool(down & high)
        up, down = (up << 1 | 1) & mask, down << 1 & mask
        plus, minus = down | ~(vertical | up) & mask, up & vertical
        best = min(best, score)
    return best


class Walks:
    """CGK walks of one length class: ``keys`` hashes the strings that begin at places of a buffer."""

    def __init__(self, steps: int, walks: int, seed: int):
        random = np.random.default_rng(seed)
        self.walks, self.steps = walks, steps
        self.bits = random.integers(0, 2, (steps, walks * 256), dtype=np.int8)
        places = random.integers(0, steps, (walks, SAMPLED))
        # at each step, the walks whose byte enters their key
        self.sampled = [np.flatnonzero((places == step).any(1)) for step in range(steps)]
        self.factors = random.integers(1, 1 << 62, steps, dtype=np.int64) * 2 + 1

    def keys(self, buffer: np.ndarray, starts: np.ndarray, room: int) -> np.ndarray:
        """[walk, start] hashes; a string ends after ``room`` bytes."""
        parts = [self._keys(buffer, starts[i:i + 2000], room) for i in range(0, len(starts), 2000)]
        return np.concatenate(parts, axis=1) if parts else np.empty((self.walks, 0), np.int64)

    def _keys(self, buffer: np.ndarray, starts: np.ndarray, room: int) -> np.ndarray:
        width = room + self.steps  # zeros after the end: a walk never leaves its row
        rows = np.zeros((len(starts), width), np.uint8)
        inside = starts[:, None] + np.arange(room)
        rows[:, :room] = np.where(inside < len(buffer), buffer[np.minimum(inside, len(buffer) - 1)], 0)
        flat = rows.ravel()
        at = np.tile(np.arange(len(starts)) * width, (self.walks, 1))
        walk = (np.arange(self.walks) * 256)[:, None]
        seen = np.zeros(at.shape, np.int64)
        for step in range(self.steps):
            byte = flat[at]
            if len(now := self.sampled[step]):
                seen[now] = (seen[now] ^ (byte[now] + 1)) * self.factors[step]
            at += self.bits[step][walk + byte]
        return seen


class LengthClass:
    """Items of similar length, with their walks and buckets."""

    def __init__(self, items: list[tuple[int, bytes]], max_edit: float, target: float, walks: int | None = None):
        self.items = items
        sizes = [len(x) for _, x in items]
        self.short, self.long = min(sizes), max(sizes)
        self.edits = [int(n * max_edit) for n in sizes]
        self.span = self.long + max(self.edits) - GRAM + 1
        self.least = min(n - GRAM + 1 - k * GRAM for n, k in zip(sizes, self.edits))
        self.steps = max(SAMPLED, int(1.6 * self.short))
        self.walks = Walks(self.steps, walks or self._needed_walks(max_edit, target), SEED + 1)

    @cached_property
    def buckets(self) -> list[dict[int, list[int]]]:
        found: list[dict[int, list[int]]] = []
        for row in self.walks.keys(*_joined([x for _, x in self.items]), self.short):
            found.append({})
            for i, key in enumerate(row.tolist()):
                found[-1].setdefault(key, []).append(i)
        return found

    def _needed_walks(self, max_edit: float, target: float) -> int:
        """Walks that reach the target recall on items with the most edits allowed, in random places.

        The chance of a common bucket depends on where the edits lie, so it is taken for each
        trial by itself.
        """
        random, trial = np.random.default_rng(SEED), Walks(self.steps, TRIAL_WALKS, SEED)
        chosen = [self.items[i][1] for i in random.integers(0, len(self.items), TRIALS)]
        changed = [spoiled(x, int(len(x) * max_edit), random) for x in chosen]
        agree = trial.keys(*_joined(chosen), self.short) == trial.keys(*_joined(changed), self.short)
        chance = (agree.sum(0) + 0.5) / (TRIAL_WALKS + 1)
        walks = 1
        while (1 - (1 - chance) ** walks).mean() < target:
            walks += 1
        return walks

    def matches(self, buffer: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(index of the start, index of the item, distance) of windows that match."""
        tried = set()
        for bucket, row in zip(self.buckets, self.walks.keys(buffer, starts, self.short)):
            for i in np.flatnonzero(np.isin(row, list(bucket))):
                tried.update((int(i), item) for item in bucket[int(row[i])])
        for i, item in sorted(tried):
            text, k = self.items[item][1], self.edits[item]
            distance = prefix_distance(text, buffer[starts[i]:starts[i] + len(text) + k].tobytes())
            if distance <= k:
                yield i, item, distance


def spoiled(text: bytes, edits: int, random: np.random.Generator) -> bytes:
    """``text`` after so many random substitutions, insertions and deletions."""
    out = bytearray(text)
    for _ in range(edits):
        at, kind, byte = int(random.integers(0, len(out))), random.integers(0, 3), int(random.integers(97, 123))
        if kind == 0:
            out[at] = byte
        elif kind == 1:
            out.insert(at, byte)
        elif len(out) > 1:
            del out[at]
    return bytes(out)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one buffer, a zero byte after each, and where they begin."""
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    return np.frombuffer(b"\0".join(texts) + b"\0", np.uint8), np.cumsum(sizes) - sizes


def _gram_places(buffer: np.ndarray) -> np.ndarray:
    """Bitmap place of the gram at each position."""
    if len(buffer) < GRAM:
        return np.empty(0, np.int64)
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buffer, GRAM)).view("<u8")[:, 0]
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _null_last(item: int | None) -> tuple[bool, int]:
    return item is None, item or 0


def window_starts(buffer: np.ndarray) -> np.ndarray:
    """Whether a window may begin at each place of texts that a zero byte ends."""
    if not len(buffer):
        return np.empty(0, bool)
    digit = (buffer >= 48) & (buffer <= 57)
    letter = (buffer >= 97) & (buffer <= 122) | (buffer >= 65) & (buffer <= 90)
    sign = np.zeros(len(buffer), bool)  # the signs of Latin-1, of two bytes
    sign[:-1] = (buffer[:-1] == 0xC2) & (buffer[1:] >= 0x80)
    tail = (buffer & 0xC0) == 0x80  # later bytes of a character
    wide = buffer >= 0xE0
    # of each place, where its character begins
    head = np.maximum.accumulate(np.where(tail, 0, np.arange(len(buffer))))
    within = digit | letter | (buffer >= 0x80) & ~sign[head] & ~wide[head]
    starts = ~tail & (buffer != 32) & (buffer != 0)
    starts[1:] &= ~(within[1:] & within[:-1])
    return starts


class Benchmark:
    """The items of one pass.  Items under GRAM bytes match exactly, between places where windows may begin."""

    def __init__(self, items: list[tuple[int | None, bytes]], max_edit: float = MAX_EDIT, target: float = TARGET_RECALL):
        ordered = sorted(items, key=lambda x: (len(x[1]), _null_last(x[0]), x[1]))
        self.items, self.max_edit, self.target = ordered, max_edit, target
        self.walks: list[int] | None = None
        self.walks = [c.walks.walks for c in self.classes]  # fitted once; tasks rebuild the rest

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("items", "max_edit", "target", "walks")}

    @cached_property
    def tiny(self) -> list[tuple[int, bytes]]:
        return [x for x in self.items if 0 < len(x[1]) < GRAM]

    @cached_property
    def classes(self) -> list[LengthClass]:
        groups: list[list] = []
        for x in self.items:
            if len(x[1]) >= GRAM:
                if groups and len(x[1]) <= CLASS_RATIO * len(groups[-1][0][1]):
                    groups[-1].append(x)
                else:
                    groups.append([x])
        return [LengthClass(g, self.max_edit, self.target, self.walks[i] if self.walks else None)
                for i, g in enumerate(groups)]

    @cached_property
    def marks(self) -> np.ndarray:
        """At the place of each gram, a bit for each length class that has it; every 64th class shares a bit."""
        marks = np.zeros(1 << BITMAP_BITS, np.uint64)
        for i, group in enumerate(self.classes):
            for _, text in group.items:
                marks[_gram_places(np.frombuffer(text, np.uint8))] |= np.uint64(1 << i % 64)
        return marks

    @cached_property
    def bitmap(self) -> np.ndarray:
        return self.marks != 0

    def windows(self, buffer: np.ndarray, starts: np.ndarray) -> Iterator[tuple[LengthClass, np.ndarray]]:
        """For each class the starts whose windows have as many grams of its items as a match has at least.

        Starts without that many grams of any class within the widest span are left out once for all.
        """
        places = _gram_places(buffer)
        hits = np.flatnonzero(self.bitmap[places])

        def within(where: np.ndarray, some: np.ndarray, span: int, least: int) -> np.ndarray:
            if least < 1:
                return some
            first, last = where[:max(0, len(where) - least + 1)], where[least - 1:]  # of so many neighbouring hits
            close = last - first < span
            begins = np.searchsorted(some, last[close] - span, "right")
            return some[union_mask(len(some), begins, np.searchsorted(some, first[close], "right"))]

        near = within(hits, starts, max(c.span for c in self.classes), min(c.least for c in self.classes))
        bits = self.marks[places[hits]]
        for i, group in enumerate(self.classes):
            of_class = hits[(bits >> np.uint64(i % 64) & np.uint64(1)).astype(bool)]
            if len(kept := within(of_class, near, group.span, group.least)):
                yield group, kept

    def hits(self, texts: list[bytes]) -> list[dict[int, int]]:
        """For each normalised text, the items found in it with their least distance."""
        found: list[dict[int, int]] = [{} for _ in texts]
        buffer, begins = _joined(texts)
        begin = window_starts(buffer)
        for group, kept in self.windows(buffer, np.flatnonzero(begin)) if self.classes else ():
            of = np.searchsorted(begins, kept, "right") - 1
            for i, item, distance in group.matches(buffer, kept):
                name = group.items[item][0]
                best = found[of[i]]
                best[name] = min(distance, best.get(name, distance))
        edge = begin | (buffer == 32) | (buffer == 0)
        for i, text in enumerate(texts if self.tiny else ()):
            for name, item in self.tiny:
                at = text.find(item)
                while at >= 0 and not (edge[begins[i] + at] and edge[begins[i] + at + len(item)]):
                    at = text.find(item, at + 1)
                if at >= 0:
                    found[i][name] = 0
        return found


def passes(items: DataFrame, id_col: str, text_col: str, pass_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in parts of bounded size, each brought to the driver by itself."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(
        F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // pass_bytes))
    for part in range(parts):
        some = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).distinct().collect()
        yield [(r[0], t) for r in some if (t := normal(r[1]))]


def contamination(docs: DataFrame, items: DataFrame, max_edit: float = MAX_EDIT, target: float = TARGET_RECALL,
                  id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", pass_bytes: int = PASS_BYTES, keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, contaminated, n_items, min_distance, items (ids in order).

    Null and empty texts contain nothing; null or empty items are in no text.  Items
    with the same id count once, and so do all items without an id, as a null at the end of ``items``.  ``min_distance`` is null where nothing was found.
    Null and repeated document ids are carried along.  With ``keep`` the columns of ``docs``
    come first and the others begin with ``_``.  No shuffle.
    """
    hit = "array<struct<item long, distance int>>"

    def search(model: Benchmark):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [normal(t) for t in batch.column(batch.schema.get_field_index("_text")).to_pylist()]
                before = batch.column(batch.schema.get_field_index("_hits")).to_pylist()
                found = []
                for start, end in chunks_by_bytes([len(t) for t in texts], BATCH_BYTES):
                    found += model.hits(texts[start:end])
                hits = [(b or []) + [{"item": k, "distance": d} for k, d in sorted(f.items(), key=lambda x: _null_last(x[0]))]
                        for b, f in zip(before, found)]
                where = batch.schema.get_field_index("_hits")
                yield batch.set_column(where, "_hits", pa.array(hits, batch.schema.field(where).type))
        return run

    kept = [F.col(c) for c in docs.columns] if keep else [F.col(id_col).cast("long").alias(id_col)]
    rows = docs.select(*kept, F.col(text_col).cast("string").alias("_text"), F.array().cast(hit).alias("_hits"))
    for some in passes(items, item_id, item_text, pass_bytes):
        if some:
            rows = rows.mapInArrow(in_slices(search(Benchmark(some, max_edit, target))), rows.schema)
    ids = F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["item"])))
    mark = "_" if keep else ""
    return rows.select(
        *(docs.columns if keep else [id_col]), (F.size("_hits") > 0).alias(f"{mark}contaminated"),
        F.size(ids).cast("long").alias(f"{mark}n_items"),
        F.array_min(F.transform("_hits", lambda h: h["distance"])).cast("long").alias(f"{mark}min_distance"),
        ids.alias(f"{mark}items"))
