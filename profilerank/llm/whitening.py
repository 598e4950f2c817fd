"""Embedding whitening by polarisation.

The covariance of two dimensions follows from three variances: of the one, of the other and
of their sum.  So squares are all that is added up: of every centred dimension and of the
centred sum of every two.  Vectors become whole numbers first and n * x - S is centred
without a fraction, so the sums are exact and do not depend on the order of the rows; the
only rounding is that of the finished covariances.

Sums are carried as limbs of 60 bits with a sign, which Spark adds as decimals.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from profilerank.llm.common import stored

SCALE = 256
COMPONENTS = 4
LIMB, LIMBS = 60, 6
ROWS = 1024  # rows of one block: their squares of 25-bit parts add up within 63 bits
PASS_NUMBERS = 1 << 24  # covariances of the widths that are fitted in one pass
_LIMB_NAMES = [f"limb{i}" for i in range(LIMBS)]
_SUMS = "width int, a int, b int, " + ", ".join(f"{c} long" for c in _LIMB_NAMES)


def whole_numbers(vector: str, scale: int = SCALE) -> Column:
    """The vector as floor(scale * c); null where it is null or holds null or non-finite entries.

    Numbers beyond a long stop at its ends.
    """
    as_double = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(as_double, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(finite, F.transform(as_double, lambda c: F.floor(c * scale).cast("long")))


def _limbs(value: int) -> list[int]:
    sign, value = (-1 if value < 0 else 1), abs(value)
    parts = [sign * (value >> LIMB * i & (1 << LIMB) - 1) for i in range(LIMBS)]
    if value >> LIMB * LIMBS:
        raise OverflowError("a sum of squares beyond the limbs")
    return parts


def _value(limbs) -> int:
    return sum(int(x or 0) << LIMB * i for i, x in enumerate(limbs))


def _exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of whole numbers."""
    if x.dtype == object or not len(x):
        return [int(v) for v in x.sum(0)]
    if max(abs(int(x.min())), abs(int(x.max()))) * len(x) < 1 << 62:
        return x.sum(0).tolist()
    return [int(v) for v in x.astype(object).sum(0)]


def _square_sums(x: np.ndarray) -> list[int]:
    """Column sums of squares of at most ROWS rows, exact at any size of the numbers."""
    if x.dtype != object:
        most = max(abs(int(x.min())), abs(int(x.max())))
        if most * most * len(x) < 1 << 62:
            return (x * x).sum(0).tolist()
        if most < 1 << 50:
            high, low = x >> 25, x & (1 << 25) - 1
            return [(h << 50) + (m << 26) + s for h, m, s in zip(
                (high * high).sum(0).tolist(), (high * low).sum(0).tolist(), (low * low).sum(0).tolist())]
        x = x.astype(object)
    return [int(v) for v in (x * x).sum(0)]


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, as Python integers where a long might not hold them or the sum of two."""
    most = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    largest = max((abs(int(s)) for s in sums), default=0)
    if n * most + largest < 1 << 61:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _by_width(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, vectors as a matrix) of the vectors of a batch, in blocks of ROWS rows."""
    vectors = batch.column(column)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    begins = np.array(vectors.offsets)[: len(vectors) + 1] - vectors.offsets[0].as_py()
    widths = np.diff(begins)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        for at in range(0, len(rows), ROWS):
            some = rows[at:at + ROWS]
            yield width, some, flat[begins[some][:, None] + np.arange(width)].astype(np.int64)


def _sum_batches(totals: dict) -> Iterator[pa.RecordBatch]:
    rows = [(*key, *_limbs(value)) for key, value in totals.items()]
    for at in range(0, len(rows), 100_000):
        columns = list(zip(*rows[at:at + 100_000]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns[:3]] + [pa.array(c, pa.int64()) for c in columns[3:]],
                                         names=["width", "a", "b", *_LIMB_NAMES])


def _first_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of every dimension."""
    totals: dict = defaultdict(int)
    for batch in batches:
        for width, _, x in _by_width(batch, 0):
            for a, value in enumerate(_exact_sums(x)):
                totals[width, a, a] += value
    yield from _sum_batches(totals)


def _second_sums(centres: dict[int, tuple[int, np.ndarray]]):
    """Sums of squares of every centred dimension (a, a) and of the sum of every two (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = defaultdict(int)
        for batch in batches:
            for width, _, x in _by_width(batch, 0):
                y = _centred(x, *centres[width])
                for a in range(width):
                    pairs = y[:, a:] + y[:, a:a + 1]
                    pairs[:, 0] = y[:, a]
                    for b, value in enumerate(_square_sums(pairs), a):
                        totals[width, a, b] += value
        yield from _sum_batches(totals)
    return run


def _added(rows: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    """Sums by width and pair, brought to the driver: a number for each covariance, however many rows."""
    sums = rows.groupBy("width", "a", "b").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in _LIMB_NAMES])
    found: dict = defaultdict(dict)
    for r in sums.collect():
        found[r[0]][r[1], r[2]] = _value(r[3:])
    return found


class Whitening:
    """Of one width: n, S, trace, the leading eigenvalues and unit eigenvectors (one in each row)."""

    def __init__(self, n: int, sums: list[int], squares: dict[tuple[int, int], int], components: int):
        width = len(sums)
        self.n, self.sums = n, np.array(sums, dtype=object)
        covariance = np.empty((width, width))
        for a in range(width):
            covariance[a, a] = squares[a, a] / n ** 3
            for b in range(a + 1, width):
                covariance[a, b] = covariance[b, a] = (squares[a, b] - squares[a, a] - squares[b, b]) / (2 * n ** 3)
        self.covariance = covariance
        self.trace = sum(squares[a, a] for a in range(width)) / n ** 3
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = values[order], vectors.T[order]
        for v in self.vectors:  # of the two signs, that of a positive largest entry
            v *= np.sign(v[np.abs(v).argmax()])
        self.usable = self.values > max(0.0, float(values.max(initial=0.0))) * width * np.finfo(float).eps
        self.explained = [float(e / self.trace) if self.trace > 0 else None for e in np.maximum(self.values, 0)]

    def project(self, x: np.ndarray) -> tuple[list[list[float | None]], list[int]]:
        """Whitened components and sum of squares of n * x - S of each row."""
        y = _centred(x, self.n, self.sums)
        deviation = [int(v) for v in (y.astype(object) ** 2).sum(1)]
        z = np.array(y, np.float64) / self.n
        columns = [(z * v).sum(1) / np.sqrt(e) if ok else None for v, e, ok in zip(self.vectors, self.values, self.usable)]
        rows = [[None if c is None else float(c[i]) for c in columns] for i in range(len(x))]
        return rows, deviation


def _project(models: dict[int, Whitening]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            white: list = [None] * batch.num_rows
            square: list = [None] * batch.num_rows
            for width, rows, x in _by_width(batch, batch.num_columns - 1):
                for i, w, d in zip(rows.tolist(), *models[width].project(x)):
                    white[i], square[i] = w, Decimal(d) if d < 10 ** 38 else None
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(square, pa.decimal128(38, 0)), pa.array(white, pa.list_(pa.float64()))],
                names=[*batch.schema.names, "deviation", "whitened"])
    return run


def _projected(rows: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """``rows``, whose last column is x, with deviation and whitened."""
    schema = T.StructType([*rows.schema.fields, T.StructField("deviation", T.DecimalType(38, 0)),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(_project(models), schema)


def _identity_errors(fit: DataFrame, models: dict[int, Whitening], components: int) -> dict[int, float | None]:
    """By width, the largest entry of the whitened fit list's covariance minus the identity."""
    white = _projected(fit, models).select(F.size("x").alias("width"), *[
        F.try_element_at("whitened", F.lit(i + 1)).alias(f"w{i}") for i in range(components)])
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    found = {}
    for r in white.groupBy("width").agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).collect():
        off = [abs(c - (a == b)) for (a, b), c in zip(pairs, r[1:]) if c is not None]
        found[r[0]] = max(off, default=None)
    return found


def _passes(sizes: list[tuple[int, int]]) -> Iterator[dict[int, int]]:
    """(width, n) in parts whose covariances have a bound."""
    part: dict[int, int] = {}
    for width, n in sizes:
        if part and sum(w * w for w in part) + width * width > PASS_NUMBERS:
            yield part
            part = {}
        part[width] = n
    if part:
        yield part


def whitened(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id",
             vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out.  The fit list is
    each distinct vector of whole numbers once.  Vectors of another length are a fit of their own;
    those of length 0 have no components.  A component without variance (one distinct vector,
    or fewer dimensions' worth of them than components) has a null ``whitened`` value, and
    ``explained`` is null if there is no variance at all.  ``deviation`` is a decimal, null
    beyond 38 digits.  Null and repeated ids are carried along; other columns are ignored.
    An empty table gives no rows.
    """
    usable = stored(rows.select(F.col(id_col).cast("long").alias("id"), whole_numbers(vector_col, scale).alias("x"))
                    .filter(F.size("x") > 0), "vectors")
    fit = stored(usable.select("x").distinct(), "fit")
    sizes = sorted((r[0], r[1]) for r in fit.groupBy(F.size("x")).count().collect())  # a row for each width
    kind = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    found = rows.sparkSession.createDataFrame([], kind)
    for part in _passes(sizes):
        inside = F.size("x").isin(list(part))
        some = fit.filter(inside)
        sums = _added(some.mapInArrow(_first_sums, _SUMS))
        centres = {w: (n, np.array([sums[w][a, a] for a in range(w)], dtype=object)) for w, n in part.items()}
        squares = _added(some.mapInArrow(_second_sums(centres), _SUMS))
        models = {w: Whitening(n, centres[w][1], squares[w], components) for w, n in part.items()}
        errors = _identity_errors(some, models, components)
        facts = {w: (m.n, m.explained, errors[w]) for w, m in models.items()}
        table = rows.sparkSession.createDataFrame(
            [(w, n, e, error) for w, (n, e, error) in facts.items()],
            "width int, n long, explained array<double>, identity_error double")
        result = (_projected(usable.filter(inside), models).withColumn("width", F.size("x"))
                  .join(F.broadcast(table), "width")  # a row for each width of the pass
                  .select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")))
                  .select("id", (F.col("pos") + 1).alias("component"), "n", "deviation", "col.whitened", "col.explained", "identity_error"))
        found = found.union(result)
    return found.withColumnRenamed("id", id_col)
