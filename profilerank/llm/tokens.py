"""Token counts in Arrow batches.

A text is cut before every space that is followed by a visible character.  The
split rule of byte-level BPE starts a new piece at such a space whatever stands
around it, so the parts can be encoded one by one, and each distinct part of a
batch only once.  A text with any other space (two in a row, one at the end, one
before other white space) is encoded whole.

``tokenizers`` takes tens of microseconds a call, which is most of the time for short
parts.  Where the same vocabulary is given as ``tiktoken`` ranks too, parts of
Latin letters and ASCII signs go through these, and all others through ``tokenizers``;
each worker compares both on its first parts and stops if they differ.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from profilerank.llm.common import chunks_by_bytes

BATCH_BYTES = 4 << 20
CACHED_PARTS = 300_000
CHECKED_PARTS = 300
#: Both libraries split these characters alike; the range has no newly assigned letters.
PLAIN = re.compile("[ -~\n\t\u00a1-\u024f]*")
UNSAFE_SPACE = r" ([\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"
_ENCODERS: dict[tuple, Encoder] = {}


class Encoder:
    """Token ids of whole batches, by one tokenizer file of the ``tokenizers`` library."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        from tokenizers import Tokenizer

        self._tokenizer, self._twin = Tokenizer.from_file(path), None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self._twin = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self._unchecked = CHECKED_PARTS
        self._forget()

    @classmethod
    def at(cls, *paths: str | None) -> Encoder:
        """One encoder for each tokenizer and worker process."""
        if paths not in _ENCODERS:
            _ENCODERS[paths] = cls(*paths)
        return _ENCODERS[paths]

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._starts = np.empty(0, np.int64)
        self._lengths = np.empty(0, np.int64)
        self._pool = np.empty(0, np.uint32)

    def _slow(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(parts), 4000) for e in
                self._tokenizer.encode_batch_fast(parts[at:at + 4000], add_special_tokens=False)]

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row, and the number of each."""
        if self._twin:
            fast = self._twin.encode_ordinary
            found = [fast(p) if PLAIN.fullmatch(p) and "<|" not in p else None for p in parts]
            odd = [i for i, x in enumerate(found) if x is None]
            for i, ids in zip(odd, self._slow([parts[i] for i in odd])):
                found[i] = ids
            if self._unchecked > 0 and (n := min(self._unchecked, len(parts))):
                if self._slow(parts[:n]) != found[:n]:
                    raise ValueError("the ranks are not those of the tokenizer")
                self._unchecked -= n
        else:
            found = self._slow(parts)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _places(self, parts: list[str]) -> np.ndarray:
        """Index of each part among those already encoded; encodes the others."""
        if len(self._known) > CACHED_PARTS:
            self._forget()
        new = [p for p in parts if p not in self._known]
        if new:
            ids, lengths = self._encode([" " + p for p in new])
            self._known.update(zip(new, range(len(self._known), len(self._known) + len(new))))
            self._starts = np.r_[self._starts, len(self._pool) + np.cumsum(lengths) - lengths]
            self._lengths = np.r_[self._lengths, lengths]
            self._pool = np.r_[self._pool, ids]
        return np.fromiter(map(self._known.__getitem__, parts), np.int64, len(parts))

    def _parts(self, texts: pa.Array):
        """Per part its start in a pool and its number of ids; where each text's parts begin."""
        unsafe = pc.match_substring_regex(texts, UNSAFE_SPACE)
        cut = pc.split_pattern(pc.if_else(unsafe, "", texts), " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        parts = cut.flatten().dictionary_encode()
        places = self._places(parts.dictionary.to_pylist())[parts.indices.to_numpy(zero_copy_only=False)]
        starts, lengths = self._starts[places], self._lengths[places]
        # the first part has no space before it, an unsafe text is one part
        heads = pc.if_else(unsafe, texts, pc.list_element(cut, 0)).to_pylist()
        ids, sizes = self._encode(heads)
        starts[bounds[:-1] - bounds[0]] = len(self._pool) + np.cumsum(sizes) - sizes
        lengths[bounds[:-1] - bounds[0]] = sizes
        return np.r_[self._pool, ids], starts, lengths, bounds - bounds[0]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text (no nulls)."""
        if not len(texts):
            return np.empty(0, np.int64)
        _, _, lengths, bounds = self._parts(texts)
        return np.add.reduceat(lengths, bounds[:-1])

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (no nulls)."""
        if not len(texts):
            return []
        pool, starts, lengths, bounds = self._parts(texts)
        ends = np.cumsum(lengths)
        flat = pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return np.split(flat, np.r_[0, ends][bounds[1:-1]])


def filled(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "")


def batches_by_bytes(batches: Iterator[pa.RecordBatch], column: int,
                     limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches that hold ``limit`` bytes of text at most, and the bytes of each text."""
    for batch in batches:
        sizes = pc.binary_length(filled(batch.column(column))).to_numpy(zero_copy_only=False).astype(np.int64)
        for start, end in chunks_by_bytes(sizes.tolist(), limit):
            yield batch.slice(start, end - start), sizes[start:end]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, ranks: str | None = None,
                 pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is a file of the ``tokenizers`` library with a byte-level split, at
    the same place on every executor; ``ranks`` may name the same vocabulary as
    ``tiktoken`` ranks, with the split ``pattern``.  Null texts count as empty, with 0 tokens; ids,
    null or repeated, are carried along; other columns are ignored.  No shuffle.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer, ranks, pattern)
        for part, sizes in batches_by_bytes(batches, 1):
            n = encoder.counts(filled(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return (rows.mapInArrow(count, "id long, n_bytes long, n_tokens long, over_limit boolean")
            .withColumnRenamed("id", id_col))
