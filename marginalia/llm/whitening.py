"""Whitened vectors: principal components from MLlib's singular values of the centred rows, each scaled to variance 1.

Components are turned into whole numbers first, so sums, means and the total variance
come from exact integers; only what has been centred is ever multiplied in floating
point. The driver holds what is as large as a vector, or its square: sums, components,
and the covariance of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import cut

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Whole numbers beyond this stand for themselves no longer (doubles have no more digits there).
MOST = 2**52
#: Components with less than this share of the largest singular value are rounding, not variance.
LEAST = 1e-6


def sound(v: Column) -> Column:
    """Neither null nor with a null or non-finite entry."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(v: Column, scale: int, shift: int, most: int = MOST) -> Column:
    """Entries as floor(scale * entry) + shift, before the shift held within ``most`` either way."""
    return F.transform(v, lambda x: F.floor(F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), F.lit(float(most))), F.lit(float(-most)))) + F.lit(shift).cast("long"))


def matrix(column: pa.ListArray, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _fits(bound: int) -> bool:
    return bound < 2**62


def sums_of(rows: DataFrame) -> DataFrame:
    """``dim, n, s``: rows of each length, and the sum of each of their entries, exactly. ``rows``: ``dim, x``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for t in batches:
            dims = t.column("dim").to_numpy()
            for d in np.unique(dims):
                x = matrix(t.column("x").take(pa.array(np.flatnonzero(dims == d))))
                own = sums.setdefault(int(d), [0, np.zeros(int(d), object)])
                own[0] += len(x)
                own[1] += x.sum(axis=0, dtype=np.int64 if _fits(len(x) * int(np.abs(x).max(initial=0))) else object)
        flat = [(d, i, n, Decimal(int(v))) for d, (n, s) in sums.items() for i, v in enumerate(s)]
        if flat:
            d, i, n, v = zip(*flat, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(i, pa.int32()), pa.array(n, pa.int64()), pa.array(v, pa.decimal128(38, 0))], ["dim", "at", "n", "s"])

    by = rows.mapInArrow(work, "dim int, at int, n long, s decimal(38,0)").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return by.groupBy("dim").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "s")))["s"].alias("s"))  # as many as a vector has


def centred(rows: DataFrame, n: int, s: list[int]) -> DataFrame:
    """``vec_id, c, deviation``: rows less the mean, and their squared distances from it, exactly, n * n fold."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    sums = np.array(s, object)
    largest = max(abs(v) for v in s)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x = matrix(t.column("x"))
            if _fits(n * int(np.abs(x).max(initial=0)) + largest):
                apart = n * x - sums.astype(np.int64)
            else:
                apart = n * x.astype(object) - sums
            far = int(np.abs(apart).max(initial=0))
            wide = apart if _fits(far * far * x.shape[1]) else apart.astype(object)
            squares = [Decimal(int(v)) for v in (wide * wide).sum(axis=1)]
            c = (apart / n).astype(np.float64)
            yield pa.RecordBatch.from_arrays([t.column("vec_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(c.ravel())), pa.array(squares, pa.decimal256(76, 0)).cast(pa.decimal128(38, 0), safe=True)], ["vec_id", "c", "deviation"])

    return rows.select("vec_id", "x").mapInArrow(work, f"vec_id {kind}, c array<double>, deviation decimal(38,0)")


def principal(rows: DataFrame, n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors (columns) and eigenvalues of the covariance of the centred ``c``, largest first; each vector's largest entry is positive."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("c").alias("c")), "c")
    dim = len(rows.first()["c"])
    svd = RowMatrix(vectors, n, dim).computeSVD(min(components, dim), computeU=False, rCond=LEAST)
    singular, v = svd.s.toArray(), svd.V.toArray()
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return v[:, singular > 0], (singular * singular / n)[singular > 0]


def _identity_error(rows: DataFrame, to: np.ndarray, n: int) -> float:
    """The largest entry of the covariance of ``c`` times ``to``, less the identity; the means of ``c`` are zero."""
    k = to.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for t in batches:
            w = matrix(t.column("c"), np.float64) @ to
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["at", "v"])

    sums = rows.select("c").mapInArrow(work, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # components squared
    covariance = np.zeros(k * k)
    for r in sums:
        covariance[r["at"]] = r["v"] / n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())


def _whitened(rows: DataFrame, n: int, s: list[int], components: int) -> DataFrame | None:
    kind = rows.schema["vec_id"].dataType.simpleString()
    made = cut(centred(rows, n, s))
    spread = int(made.agg(F.sum("deviation")).first()[0])
    if not spread:
        return None
    v, e = principal(made, n, components)
    to = v / np.sqrt(e)
    error = _identity_error(made, to, n)
    k, explained = len(e), e * (n**3 / spread)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for some in (t.slice(at, 2048) for at in range(0, t.num_rows, 2048)):
                w = matrix(some.column("c"), np.float64) @ to
                row = pa.array(np.repeat(np.arange(len(w)), k))
                every = lambda x: pa.array(np.tile(x, len(w)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([some.column("vec_id").take(row), every(np.arange(1, k + 1, dtype=np.int32)), some.column("deviation").take(row), pa.array(w.ravel()), every(explained)], ["vec_id", "component", "deviation", "whitened", "explained"])

    out = made.mapInArrow(work, f"vec_id {kind}, component int, deviation decimal(38,0), whitened double, explained double")
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and each of the first ``components``.

    Entries count as floor(scale * entry) + shift (before the shift within 2**52 either
    way). Covariances divide by the number of rows. ``deviation`` is the row's squared
    distance from the mean times n * n, null where a long doesn't hold it; ``explained``
    is a component's share of the total variance, which comes from all deviations.
    Rows whose vector is null or holds null or non-finite entries are left out; ids may
    be null, of any type, and repeat: each row counts. Directions without variance have
    no component, so single or equal vectors give no rows, and neither do empty vectors
    or an empty table. Vectors of each length are fitted and whitened by themselves.
    """
    kind = vectors.schema[id].dataType.simpleString()
    v = F.col(vector)
    rows = cut(vectors.where(sound(v) & (F.size(v) > 0)).select(F.col(id).alias("vec_id"), F.size(v).alias("dim"), whole(v, scale, shift).alias("x")))
    out = None
    for r in sums_of(rows.select("dim", "x")).collect():  # a row for each length of vectors
        own = _whitened(rows.where(F.col("dim") == r["dim"]), r["n"], [int(x) for x in r["s"]], components)
        if own is not None:
            out = own if out is None else out.unionByName(own)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out
