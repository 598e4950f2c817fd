"""Packing of token sequences by the sum-of-squares rule.

A level array counts the partly filled windows of every fill.  Each document,
less its full windows, goes to the level after which the sum of the squared
counts is smallest; ties go to the fullest.  Levels stay evenly occupied, so
a fitting hole is nearly always there.

Every task packs its own partition online; nothing is shuffled.  Rows leave when
their window is full.  What is still open at the end of a task is cut anew
into full windows, and the last rest into windows of powers of two, which need
no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from profilerank.llm.tokens import Encoder, batches_by_bytes, filled

WINDOW = 1024
END_ID = 0
SCHEMA = ("id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


class SumOfSquares:
    """Windows by fill level.  ``place`` names the window of a part of ``size`` ids."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)  # full windows are not counted
        self.open: list[list[int]] = [[] for _ in range(window)]

    def place(self, size: int, fresh: int) -> tuple[int, int, bool]:
        """(window, offset, is full) for 1 <= size < window; ``fresh`` names a new window."""
        # leaving level h changes the sum by 1 - 2 N[h], reaching level g by 1 + 2 N[g]
        reached = self.counts[size:self.window + 1] * 2 + 1
        reached[-1] = 0  # full
        left = 1 - 2 * self.counts[:self.window - size + 1]
        left[0] = 0  # a new window
        change = np.where((self.counts[:len(left)] > 0) | (np.arange(len(left)) == 0), reached + left, np.inf)
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        name = self.open[level].pop() if level else fresh
        if level:
            self.counts[level] -= 1
        if level + size < self.window:
            self.counts[level + size] += 1
            self.open[level + size].append(name)
        return name, level, level + size == self.window


class Packer:
    """Packs documents of one partition; rows are (id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window, self.next = window, first_sequence
        self.levels = SumOfSquares(window)
        self.held: dict[int, list[tuple]] = {}

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        rows, n = [], len(ids)
        for start in range(0, n - n % self.window, self.window):
            rows.append((doc, start, ids[start:start + self.window], n, self.next, 0))
            self.next += 1
        start = n - n % self.window
        if start < n:
            name, offset, full = self.levels.place(n - start, self.next)
            self.next += name == self.next
            self.held.setdefault(name, []).append((doc, start, ids[start:], n, name, offset))
            if full:
                rows += self.held.pop(name)
        return rows

    def finish(self) -> list[tuple]:
        rows, parts = [], [p for _, parts in sorted(self.held.items()) for p in parts]
        left = sum(len(p[2]) for p in parts)
        room = offset = 0
        for doc, start, ids, n, _, _ in parts:
            while len(ids):
                if not room:
                    room, offset = min(self.window, 1 << (left.bit_length() - 1)), 0
                    self.next += 1
                    left -= room
                cut = min(room, len(ids))
                rows.append((doc, start, ids[:cut], n, self.next - 1, offset))
                start, ids, room, offset = start + cut, ids[cut:], room - cut, offset + cut
        self.held.clear()
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, ids, total, sequence, offset = zip(*rows)
    crc = [zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()) for x in ids]
    return pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in (doc, start, list(map(len, ids)), crc, total, sequence, offset)],
        names=[c.split()[0] for c in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``window`` is a power of two; for the tokenizer see ``token_counts``.  A null text is empty, and an empty one is its end id
    alone.  Null or repeated ids are carried along; every row of ``docs`` is packed.
    Other columns are ignored.  An empty table gives no rows.  ``sequence_id`` holds
    the partition's number above its low 40 bits.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer, ranks, pattern)
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        end = np.array([END_ID], np.uint32)
        for part, _ in batches_by_bytes(batches, 1):
            rows = []
            for doc, ids in zip(part.column(0).to_pylist(), encoder.ids(filled(part.column(1)))):
                rows += packer.add(doc, np.concatenate([ids, end]))
            if rows:
                yield _batch(rows)
        if rows := packer.finish():
            yield _batch(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)
