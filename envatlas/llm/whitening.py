"""Whitening of embeddings from an exact integer scatter.

Entries become whole numbers, x = floor(scale * entry). Each task multiplies its block of them with itself modulo several primes: centred residues
are so small that every sum of a block's GEMM is a whole number below 2**53, so that doubles hold it exactly. Residues are summed by Spark, and
Chinese remaindering gives the exact count, sums and scatter, whatever the order of the tasks. The covariance is centred as whole numbers, and only then
becomes doubles for eigh.

The fit takes each distinct x once, so that copies weigh nothing. What reaches the driver has the size of the covariance times the
number of primes, which grows with the logarithm of the rows.

Rows whose vector is null or holds a null or non-finite entry, or is of another length than most (the shortest on ties), take no part; zero vectors do.
Repeated rows each get their result; an empty table gives no rows. Entries beyond a long's range count as its nearest end. Where all x are the
same along a component (its eigenvalue is zero up to rounding), `whitened` is null; `explained` is null if all rows are equal. Other columns pass
through, and of clashing names the operator's own takes trailing underscores. Components of equal eigenvalue have no order of their own: the one that eigh gives first
comes first. The entry of a component that is largest in absolute value (the first on ties) is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envatlas.llm.shared import column_named, drop, save, tidy
from envatlas.llm.vectors import finite, usual_length

SCALE = 256
#: Primes lie below 2**_PRIME_BITS: products of centred residues are at most 2**(2 * _PRIME_BITS - 2), and _ROWS of them stay below 2**53.
_PRIME_BITS = 21
_ROWS = 1 << 12


@dataclass
class Fit:
    """Exact count, sums by dimension and scatter of the distinct vectors; eigenvalues falling, components as columns."""

    n: int
    sums: list[int]
    scatter: list[list[int]]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(eigenvalue), NaN where the eigenvalue is zero up to rounding."""
        floor = len(self.values) * np.finfo(np.float64).eps * max(0.0, float(self.values[0])) if len(self.values) else 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > floor, 1 / np.sqrt(np.maximum(self.values, 0)), np.nan)


def primes_above(bound: int) -> list[int]:
    """The largest primes below 2**_PRIME_BITS, as many as their product needs to exceed `bound`."""
    out, product, p = [], 1, (1 << _PRIME_BITS) - 1
    while product <= bound:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def modular_scatter(x: np.ndarray, prime: int) -> np.ndarray:
    """x.T @ x modulo `prime`, exact for any whole numbers."""
    out = np.zeros((x.shape[1], x.shape[1]), dtype=np.int64)
    for a in range(0, len(x), _ROWS):
        r = x[a : a + _ROWS] % prime
        r = (r - np.where(r > prime // 2, prime, 0)).astype(np.float64)
        out = (out + (r.T @ r).astype(np.int64)) % prime
    return out


def remaindered(residues: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The whole numbers of least absolute value with these residues, as Python integers."""
    m = 1
    for p in primes:
        m *= p
    total = np.zeros(residues[0].shape, dtype=object)
    for r, p in zip(residues, primes, strict=True):
        total = total + r.astype(object) * (m // p * pow(m // p, -1, p))
    total = total % m
    return np.where(total > m // 2, total - m, total)


def whole(vector: str, scale: int = SCALE):
    """The column's entries as whole numbers."""
    return F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def _matrix(column: pa.Array, length: int, kind: type = np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, length)


def fit(vectors: DataFrame, length: int) -> Fit:
    """Fits the rows of `vectors`, one column of distinct whole vectors of that length, each once."""
    column = vectors.columns[0]
    ends = vectors.agg(F.count("*").alias("n"), F.max(F.array_max(column)).alias("high"), F.min(F.array_min(column)).alias("low")).first()
    n = ends.n
    if not n:
        return Fit(0, [], [], np.zeros(0), np.zeros((length, 0)), 0.0)
    primes = primes_above(2 * n * max(1, ends.high, -ends.low) ** 2)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((length + 1, length + 1), dtype=np.int64) for _ in primes]
        for batch in batches:
            x = _matrix(batch.column(0), length)
            x = np.concatenate([np.ones((len(x), 1), dtype=np.int64), x], axis=1)  # gives the count and the sums
            for k, p in enumerate(primes):
                sums[k] = (sums[k] + modular_scatter(x, p)) % p
        for k, s in enumerate(sums):
            rows = [s[i, i:] for i in range(length + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), type=pa.int32()), pa.array(range(len(rows)), type=pa.int32()), pa.array(rows, type=pa.list_(pa.int64()))], names=["k", "i", "row"])

    parts = vectors.mapInArrow(tidy(partial), "k int, i int, row array<bigint>")
    found = [np.zeros((length + 1, length + 1), dtype=np.int64) for _ in primes]
    for r in parts.select("k", "i", F.posexplode("row").alias("j", "v")).groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect():
        found[r.k][r.i, r.i + r.j] = found[r.k][r.i + r.j, r.i] = r.v % primes[r.k]
    exact = remaindered(found, primes)
    sums, scatter = exact[0, 1:], exact[1:, 1:]
    centred = n * scatter - np.outer(sums, sums)
    covariance = np.array([[c / (n * n) for c in row] for row in centred], dtype=np.float64)  # whole numbers divide with one rounding
    values, turned = np.linalg.eigh(covariance)
    values, turned = values[::-1], turned[:, ::-1]
    turned = turned * np.where(np.take_along_axis(turned, np.abs(turned).argmax(axis=0)[None, :], axis=0) < 0, -1.0, 1.0)
    return Fit(int(exact[0, 0]), [int(s) for s in sums], [[int(c) for c in row] for row in scatter], values, turned, sum(int(centred[i, i]) for i in range(length)) / (n * n))


def _project(x: np.ndarray, how: Fit, components: int) -> np.ndarray:
    mean = np.array([s / how.n for s in how.sums])
    return ((x.astype(np.float64) - mean) @ how.vectors[:, :components]) * how.scales[:components]


def identity_error(vectors: DataFrame, how: Fit, components: int) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured on all rows of the fit; null without a component to measure."""
    use = [i for i in range(components) if not np.isnan(how.scales[i])]
    if not use:
        return None
    length, k = len(how.sums), len(use)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k + 1, k))
        for batch in batches:
            w = _project(_matrix(batch.column(0), length), how, components)[:, use]
            sums += np.concatenate([w.sum(axis=0)[None, :], w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], names=["i", "v"])

    total = np.zeros((k + 1) * k)
    for r in vectors.mapInArrow(tidy(partial), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        total[r.i] = r.v
    total = total.reshape(k + 1, k) / how.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def _deviations(x: np.ndarray, how: Fit) -> pa.Array:
    """The sum over dimensions of (n * x - S)**2 for each row, exact; null beyond 38 digits."""
    size = max(1, int(x.max(initial=0)), -int(x.min(initial=0)))
    most = max(1, *[abs(s) for s in how.sums])
    if size * max(size, most) * x.shape[1] < 1 << 63:
        squares, products = (x * x).sum(axis=1).tolist(), (x @ np.array(how.sums, dtype=np.int64)).tolist()
    else:
        squares = [sum(c * c for c in row) for row in x.tolist()]
        products = [sum(c * s for c, s in zip(row, how.sums, strict=True)) for row in x.tolist()]
    own = sum(s * s for s in how.sums)
    out = [how.n * how.n * q - 2 * how.n * r + own for q, r in zip(squares, products, strict=True)]
    if max(out, default=0) < 1 << 63:
        return pa.array(out, type=pa.int64()).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(v) if v < 10**38 else None for v in out], type=pa.decimal128(38, 0))


def whiten(df: DataFrame, vector: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """For each row that takes part and each component up to `components`, the row's other columns and

    component (from 1, by falling eigenvalue e), n of the fit, deviation (sum over dimensions of (n * x - S)**2, a decimal of 38 digits), whitened
    (x - S/n projected on the component, over sqrt(e)), explained (e over the covariance's trace) and identity_error.
    """
    keep = [c for c in df.columns if c != vector]
    at = column_named(df, "x")
    good = df.where(finite(F.col(vector)) & (F.size(vector) > 0))
    length = usual_length(good, vector)
    whole_rows = good.where(F.size(vector) == length).select(*keep, whole(vector, scale).alias(at))
    fields = [df.schema[c] for c in keep]
    for name, kind in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.DecimalType(38, 0)), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())):
        have = {f.name.lower() for f in fields}
        while name.lower() in have:
            name += "_"
        fields.append(T.StructField(name, kind))
    schema = T.StructType(fields)
    if not length:
        return df.sparkSession.createDataFrame([], schema)
    distinct = save(whole_rows.select(at).distinct(), "whole")
    how = fit(distinct, length)
    most = min(components, length)
    error = identity_error(distinct, how, most)
    drop(distinct)
    explained = [float(e) / how.trace if how.trace else None for e in how.values[:most]]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(len(keep)), length)
            rows = np.repeat(np.arange(len(x)), most)
            projected = _project(x, how, most).ravel()
            own = [
                pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rows), how.n, dtype=np.int64)),
                _deviations(x, how).take(pa.array(rows)),
                pa.array(projected, mask=np.isnan(projected)),
                pa.array(explained * len(x), type=pa.float64()),
                pa.array([error] * len(rows), type=pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows)) for c in batch.columns[: len(keep)]], *own], names=names)

    return whole_rows.mapInArrow(tidy(run), schema)
