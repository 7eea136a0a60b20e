"""Whitening of embeddings by a compensated covariance.

Vectors become integers, the distinct ones are the fit list. Sums and centred outer products of the fit list are held in
double-double: a value is an unevaluated sum of a high and a low part, so that what a double would round away stays.
Error-free transformations do it: the centred entries are split into slices of so few bits that the matrix product of two
slices, a sum of outer products, has no rounding at all, and those products are added with the error of each addition
kept. Tasks give high and low parts by matrix row, which are merged in two steps. The matrix is small (dimensions
squared); its eigenvectors come from a tridiagonal divide-and-conquer solver, refined against the double-double matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import small_batches, stored

#: Bits of a slice, slices of an entry, rows of a block: 2 * SLICE_BITS + log2(BLOCK) <= 52, so a block's product of two slices is exact.
SLICE_BITS, SLICES, BLOCK = 20, 4, 4096
#: Groups that the tasks' parts are merged in before they are merged by matrix row.
FAN_IN = 256
_PART = "row int, high array<double>, low array<double>"


class DoubleDouble(NamedTuple):
    """An array as an unevaluated sum: ``low`` is at most half a unit in the last place of ``high``."""

    high: np.ndarray
    low: np.ndarray


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as the rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def plus(x: DoubleDouble, y: DoubleDouble) -> DoubleDouble:
    s, e = two_sum(x.high, y.high)
    t, f = two_sum(x.low, y.low)
    s, e = two_sum(s, e + t)
    return DoubleDouble(*two_sum(s, e + f))


def zero(shape: tuple[int, ...]) -> DoubleDouble:
    return DoubleDouble(np.zeros(shape), np.zeros(shape))


def column_sums(x: np.ndarray) -> DoubleDouble:
    """Sums of the columns, halves added to halves."""
    now = DoubleDouble(x, np.zeros_like(x))
    while len(now.high) > 1:
        half = len(now.high) // 2
        rest = DoubleDouble(now.high[2 * half :], now.low[2 * half :])
        added = plus(DoubleDouble(now.high[:half], now.low[:half]), DoubleDouble(now.high[half : 2 * half], now.low[half : 2 * half]))
        now = DoubleDouble(np.concatenate([added.high, rest.high]), np.concatenate([added.low, rest.low]))
    return DoubleDouble(now.high[0], now.low[0]) if len(x) else zero(x.shape[1:])


def divided(x: DoubleDouble, n: int) -> DoubleDouble:
    """x / n: the quotient of the high part, and that of what it leaves, which is made of exact products of half words."""
    q = x.high / n
    cut = q * 134217729.0
    a = cut - (cut - q)
    b, c = q - a, float(n >> 26 << 26)
    d = n - c
    remainder = ((((x.high - a * c) - a * d) - b * c) - b * d) + x.low
    return DoubleDouble(*two_sum(q, remainder / n))


def outer_products(x: np.ndarray, mean: DoubleDouble) -> DoubleDouble:
    """Sum over the rows of (x - mean)(x - mean)^T, in double-double."""
    total = zero((x.shape[1], x.shape[1]))
    for at in range(0, len(x), BLOCK):
        high, low = two_sum(x[at : at + BLOCK], -mean.high)
        low = low - mean.low
        unit = 2.0 ** (np.ceil(np.log2(np.maximum(np.abs(high).max(axis=0), 2.0**-800))) + 1 - SLICE_BITS)
        slices = []
        for _ in range(SLICES):
            part = np.rint(high / unit) * unit
            high, low = two_sum(high - part, low)
            slices.append(part)
            unit = unit * 2.0**-SLICE_BITS
        for p in range(SLICES):
            for q in range(min(p + 1, SLICES - p)):
                product = slices[p].T @ slices[q]
                total = plus(total, DoubleDouble(product, np.zeros_like(product)))
                if p != q:
                    total = plus(total, DoubleDouble(product.T.copy(), np.zeros_like(product)))
    return total


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)


def _merged(parts: pd.DataFrame) -> pd.DataFrame:
    total = None
    for high, low in zip(parts["high"], parts["low"], strict=True):
        now = DoubleDouble(np.asarray(high), np.asarray(low))
        total = now if total is None else plus(total, now)
    return pd.DataFrame({"row": [parts["row"].iloc[0]], "high": [total.high], "low": [total.low]})


def _accumulated(vectors: DataFrame, column: str, dims: int, rows: int, part: Callable[[np.ndarray], DoubleDouble]) -> DoubleDouble:
    """Sums of ``part`` over the batches of ``column``: within a task, then over the tasks by matrix row.

    A task gives ``rows`` rows of high and low parts. They are merged in FAN_IN groups a matrix row first, then by row,
    so that a merge reads a small share of the tasks' parts; what reaches the driver is one matrix.
    """

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                now = part(_matrix(batch.column(0), dims))
                total = now if total is None else plus(total, now)
        if total is not None:
            high, low = (np.atleast_2d(a) for a in total)
            yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array(list(high), pa.list_(pa.float64())), pa.array(list(low), pa.list_(pa.float64()))], ["row", "high", "low"])

    parts = vectors.select(column).mapInArrow(accumulate, _PART).withColumn("lot", F.spark_partition_id() % FAN_IN)
    for keys in (["row", "lot"], ["row"]):
        parts = parts.groupBy(*keys).applyInPandas(_merged, _PART)
    found = sorted(parts.collect())  # one row of the matrix each
    shape = (len(found[0]["high"]),) if rows == 1 else (rows, len(found[0]["high"]))
    return DoubleDouble(*(np.array([r[k] for r in found]).reshape(shape) for k in ("high", "low")))


@dataclass(frozen=True)
class Moments:
    """Of ``n`` vectors: sums of their columns, means, and centred second moments divided by n."""

    n: int
    sums: DoubleDouble
    mean: DoubleDouble
    covariance: DoubleDouble


def moments(vectors: DataFrame, column: str, dims: int, n: int) -> Moments:
    """Moments of ``n`` > 0 vectors of ``dims`` finite entries, read twice: for the sums (exact for integers up to 2^106), and centred."""
    small_batches(vectors.sparkSession, BLOCK)
    sums = _accumulated(vectors, column, dims, 1, column_sums)
    mean = divided(sums, n)
    return Moments(n, sums, mean, divided(_accumulated(vectors, column, dims, dims, lambda x: outer_products(x, mean)), n))


def eigen(matrix: DoubleDouble, refinements: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix.

    ``numpy.linalg.eigh`` reduces to tridiagonal form and solves that by divide and conquer. The vectors are then corrected
    by what V and X^T X leave off the diagonal, in extended precision, so that the matrix's low part counts; vectors whose
    eigenvalues are too close to be told apart are only made orthogonal.
    """
    x = np.linalg.eigh(matrix.high)[1].astype(np.longdouble)
    a = matrix.high.astype(np.longdouble) + matrix.low
    for _ in range(refinements):
        r, s = np.eye(len(a)) - x.T @ x, x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= 2 * (np.abs(s - np.diag(values)).max(initial=0.0) + np.abs(values).max(initial=0.0) * np.abs(r).max(initial=0.0))
        step = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ step
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    x = x / np.sqrt(np.einsum("ij,ij->j", x, x))
    order = np.argsort(-values, kind="stable")
    return values[order].astype(np.float64), x[:, order].astype(np.float64)


@dataclass(frozen=True)
class Whitener:
    """What turns a vector into whitened components: at most (components + 3) * dims doubles, whatever the input."""

    n: int
    sums: tuple[int, ...]
    mean: DoubleDouble
    scaled: np.ndarray  # columns: unit eigenvectors over the root of their eigenvalue; 0 where that is 0
    flat: tuple[bool, ...]  # components without variance
    explained: tuple[float, ...]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean.high) - self.mean.low) @ self.scaled

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)^2 of each row of integers, exact; null where a long can't hold it."""
        largest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if len(self.sums) * largest**2 < 1 << 63:
            return ((self.n * x.astype(np.int64) - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        found = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return [v if v < 1 << 63 else None for v in found]


def integers(vector: Column) -> Column:
    """floor(256 * c) of each entry; entries beyond a long are held at its ends (as doubles, 2^63 - 1024)."""
    most = F.lit(9223372036854774784.0)
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-(2.0**63)), F.least(most, c.cast("double") * 256))))


def fit(vectors: DataFrame, column: str, dims: int, components: int = 4) -> tuple[Whitener, float] | None:
    """The whitener of the distinct vectors of ``column`` (array<long> of length ``dims``), and the largest error of the whitened covariance against the identity; null without vectors.

    The error is measured: the fit list is whitened, and the covariance of that is made like the first one. Components
    whose eigenvalue is 0 but for rounding count as 0 there.
    """
    listed = stored(vectors.filter(F.size(column) == dims).select(F.col(column).alias("x")).distinct(), "fit")
    n = listed.count()
    if not n or not dims:
        return None
    found = moments(listed, "x", dims, n)
    values, axes = eigen(found.covariance)
    values, axes = values[:components], axes[:, :components]
    trace = float(np.trace(found.covariance.high) + np.trace(found.covariance.low))
    flat = values <= dims * np.finfo(float).eps * max(trace, 0.0)
    scaled = np.where(flat, 0.0, axes / np.sqrt(np.where(flat, 1.0, values)))
    sums = tuple(int(h) + int(low) for h, low in zip(*found.sums, strict=True))
    made = Whitener(n, sums, found.mean, scaled, tuple(map(bool, flat)), tuple(0.0 if f else float(v) / trace for v, f in zip(values, flat, strict=True)))
    if flat.all():
        return made, 0.0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(made.whiten(_matrix(batch.column(0), dims))), pa.list_(pa.float64()))], ["z"])

    again = moments(listed.mapInArrow(project, "z array<double>"), "z", len(values), n).covariance
    return made, float(np.abs(again.high + again.low - np.diag(np.where(flat, 0.0, 1.0))).max())


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component from 1.

    Rows whose vector is null, or holds null, NaN or infinite entries, go. Entries become floor(256 * c); entries beyond a
    long are held at its ends. Vectors of the commonest length (of equally common ones the longest) are fitted, each
    distinct one once. Vectors of other lengths, which the components don't fit, have the same rows with null deviation
    and whitened. There are as many components as asked for, or as dimensions. A component without variance (fewer
    distinct vectors than dimensions, or one vector only) has whitened null and explained 0. deviation is null where a long
    can't hold it. Repeated vectors and null or repeated ids are rows of their own; empty tables, and tables of empty
    vectors, give no rows. Columns other than the two, whatever their names, are not read.
    """
    spark = embeddings.sparkSession
    clean = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    clean = clean.filter(F.coalesce(sound, F.lit(False)))
    vectors = clean.select("id", integers(F.col("v")).alias("x"))
    lengths = vectors.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    fitted = fit(vectors, "x", lengths["dims"], components) if lengths else None
    out = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"id {dict(vectors.dtypes)['id']}, deviation long, whitened array<double>"
    if fitted is None:
        none = vectors.filter("false").select("id", F.lit(0).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("whitened"))
        return none.select(F.col("id").alias(id_col), F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), "deviation", F.element_at("whitened", 1).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error")).select(*out)
    made, error = fitted
    small_batches(spark, BLOCK)
    sent = spark.sparkContext.broadcast(made)
    dims = lengths["dims"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            fits = np.array(batch.column(1).value_lengths()) == dims
            x = _matrix(batch.column(1).filter(pa.array(fits)), dims)
            deviation = np.full(len(fits), None, dtype=object)
            rows = np.full((len(fits), len(w.flat)), None, dtype=object)
            deviation[fits], rows[fits] = w.deviation(x), w.whiten(x)
            rows[:, np.array(w.flat)] = None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    explained = F.array(*[F.lit(e) for e in made.explained])
    return vectors.mapInArrow(project, schema).select("id", "deviation", F.posexplode("whitened").alias("at", "w")).select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(made.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"),
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    ).select(*out)
