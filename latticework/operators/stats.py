"""Moments, correlation and covariance. Everything is sums of powers and products: one or two aggregations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validation as V
from ..functions.sums import array_sums


def _num(c: str) -> Column:
    return F.col(c).cast("double")


def moment(df: DataFrame, cols: list[str], order: int) -> DataFrame:
    """The central moment of each column, over n: one row. Two passes, so that large means lose no digits."""
    means = df.agg(*[F.avg(_num(c)).alias(c) for c in cols]).first()
    return df.agg(*[F.avg(F.pow(_num(c) - F.lit(means[c]), F.lit(float(order)))).alias(c) for c in cols])


def skew(df: DataFrame, cols: list[str], bias: bool = True) -> DataFrame:
    """m3 / m2^1.5; null without spread. Not ``bias``: times sqrt(n (n - 1)) / (n - 2)."""
    out = {c: F.skewness(_num(c)) for c in cols}
    if not bias:
        n = lambda c: F.count(_num(c)).cast("double")
        out = {c: e * F.when(n(c) > 2, F.sqrt(n(c) * (n(c) - 1)) / (n(c) - 2)).otherwise(1.0) for c, e in out.items()}
    return df.agg(*[e.alias(c) for c, e in out.items()])


def kurtosis(df: DataFrame, cols: list[str], bias: bool = True, variant: str = "fisher") -> DataFrame:
    """m4 / m2^2, less 3 for ``fisher``."""
    V.one_of(variant, ("fisher", "pearson"))
    out = {}
    for c in cols:
        e = F.kurtosis(_num(c))
        if not bias:
            n = F.count(_num(c)).cast("double")
            e = F.when(n > 3, ((n + 1) * e + 6) * (n - 1) / ((n - 2) * (n - 3))).otherwise(e)
        out[c] = e + 3 if variant == "pearson" else e
    return df.agg(*[e.alias(c) for c, e in out.items()])


@dataclass(frozen=True)
class Moments:
    """Weighted sums over rows of (x): n, weight, sum x, sum x x'. The last column may be a target."""

    n: int
    weight: float
    first: np.ndarray
    second: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.first / self.weight

    def covariance(self, ddof: float = 0.0) -> np.ndarray:
        m = self.mean
        return (self.second - self.weight * np.outer(m, m)) / (self.weight - ddof)


def gram(df: DataFrame, cols: list[str], weight: str | None = None, group: str | None = None, center: np.ndarray | None = None) -> dict[object, Moments]:
    """Moments of each ``group`` (or of all, under None).

    Each task sums its own Arrow batches in numpy and gives out one row a group, p x p numbers; a few tasks
    sum these, so that a fixed number of rows a group reaches the driver. Sums are taken of x - ``center``
    (a rough mean, found first where not given) and moved back, for accuracy.
    """
    p = len(cols)
    if center is None:
        row = df.agg(*[F.avg(_num(c)).alias(f"c{k}") for k, c in enumerate(cols)]).first()
        center = np.array([v or 0.0 for v in row])
    key = F.col(group) if group else F.lit(0)
    x = df.select(key.alias("g"), F.array(*[_num(c) for c in cols]).alias("x"), V.weight_column(weight).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, p) - center
            w = b.column(2).to_numpy(zero_copy_only=False)
            codes = b.column(0).dictionary_encode()
            for k, g in enumerate(codes.dictionary.to_pylist()):
                own = codes.indices.to_numpy() == k
                xs, ws = m[own], w[own]
                s = sums.setdefault(g, [0, 0.0, np.zeros(p), np.zeros((p, p))])
                s[0] += len(xs)
                s[1] += ws.sum()
                s[2] += ws @ xs
                s[3] += (xs * ws[:, None]).T @ xs
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)).cast(kind), pa.array([np.concatenate([[s[0], s[1]], s[2], s[3].ravel()]) for s in sums.values()], pa.list_(pa.float64()))], ["g", "s"])

    spark_kind = x.schema["g"].dataType.simpleString()
    kind = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "smallint": pa.int16(), "tinyint": pa.int8(), "boolean": pa.bool_()}[spark_kind]
    out = array_sums(x.where(F.col("g").isNotNull()).mapInArrow(run, f"g {spark_kind}, s array<double>"))
    found = {}
    for g, s in sorted(out.items()):
        w, f, q = s[1], s[2 : 2 + p], s[2 + p :].reshape(p, p)
        second = q + np.outer(center, f) + np.outer(f, center) + w * np.outer(center, center)
        found[g if group else None] = Moments(int(s[0]), float(w), f + w * center, second)
    return found


def _matrix_frame(df: DataFrame, cols: list[str], m: np.ndarray) -> DataFrame:
    rows = [(i, j, float(m[i, j])) for i in range(len(cols)) for j in range(len(cols))]
    return df.sparkSession.createDataFrame(rows, "i int, j int, v double")


def correlation_matrix(df: DataFrame, cols: list[str], means: list[float] | None = None) -> DataFrame:
    """(i, j, v): Pearson correlations; about given means where there are any."""
    s = gram(df, cols)[None]
    mu = s.mean if means is None else np.array(means, float)
    c = s.second - np.outer(mu, s.first) - np.outer(s.first, mu) + s.weight * np.outer(mu, mu)
    d = np.sqrt(np.diag(c))
    return _matrix_frame(df, cols, c / np.outer(d, d))


def center(df: DataFrame, cols: list[str], assume_centered: bool = False) -> DataFrame:
    if assume_centered:
        return df
    means = df.agg(*[F.avg(_num(c)).alias(c) for c in cols]).first()
    return df.withColumns({c: _num(c) - F.lit(means[c]) for c in cols})


def empirical_covariance(df: DataFrame, cols: list[str], assume_centered: bool = False) -> np.ndarray:
    """Over n. With ``assume_centered``, means count as 0."""
    s = gram(df, cols)[None]
    return s.second / s.weight if assume_centered else s.covariance()


def trace(m: np.ndarray) -> float:
    return float(np.trace(m))


@dataclass(frozen=True)
class CovarianceModel:
    covariance: np.ndarray
    shrinkage: float
    location: np.ndarray


class ShrunkCovariance:
    """(1 - s) times the covariance, plus s times its mean variance on the diagonal."""

    @staticmethod
    def fit(df: DataFrame, cols: list[str], shrinkage: float = 0.1, assume_centered: bool = False) -> CovarianceModel:
        if not 0 <= shrinkage <= 1:
            raise ValueError(f"shrinkage must be in [0, 1], got {shrinkage}")
        s = gram(df, cols)[None]
        c = s.second / s.weight if assume_centered else s.covariance()
        mu = trace(c) / len(cols)
        return CovarianceModel((1 - shrinkage) * c + shrinkage * mu * np.eye(len(cols)), shrinkage, np.zeros(len(cols)) if assume_centered else s.mean)


class LedoitWolf:
    """The shrinkage that is best for the sample (Ledoit and Wolf, 2004)."""

    @staticmethod
    def fit(df: DataFrame, cols: list[str], assume_centered: bool = False) -> CovarianceModel:
        p = len(cols)
        s = gram(df, cols)[None]
        location = np.zeros(p) if assume_centered else s.mean
        c = s.second / s.weight if assume_centered else s.covariance()
        # The sum over i and j of x_i^2 x_j^2 is the sum of squared row norms squared.
        norm = sum(((_num(a) - F.lit(float(m))) ** 2 for a, m in zip(cols, location)), F.lit(0.0))
        fourth = df.agg(F.avg(norm * norm)).first()[0]
        mu = trace(c) / p
        delta = float((c * c).sum() - 2 * mu * trace(c) + p * mu * mu) / p
        beta = min((fourth - float((c * c).sum())) / s.n / p, delta)
        shrink = 0.0 if beta == 0 else beta / delta
        return CovarianceModel((1 - shrink) * c + shrink * mu * np.eye(p), shrink, location)


# Quantiles.

#: Bits of a double that a pass settles.
BITS = 16


def _ordered(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; -0 as 0, NaN above all."""
    u = np.where(np.isnan(v), np.nan, v + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def quantiles(df: DataFrame, columns: dict[str, Column], at: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column without its nulls, by linear interpolation; null of none.

    A pass counts the rows by the next BITS bits of their value, below the prefixes that hold a rank asked for. The
    counts are dealt by these bits, so that no task gets more than a few, however many values there are; the driver
    gets as many as there are prefixes. A prefix of one value is settled at once.
    """
    names = list(columns)
    rows = df.select(*[e.cast("double").alias(f"c{k}") for k, e in enumerate(columns.values())])

    def counted(prefixes: list[list[int]], bits: int) -> dict[int, list[tuple[int, int, float, float]]]:
        """Of each column, (prefix, rows, smallest, largest) of the prefixes with BITS bits more."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, column in enumerate(b.columns):
                    v = column.drop_null().to_numpy(zero_copy_only=False)
                    u = _ordered(v)
                    if bits and not prefixes[k]:
                        continue
                    if bits:
                        keep = np.isin(u >> np.uint64(64 - bits), np.array(prefixes[k], np.uint64))
                        u, v = u[keep], v[keep]
                    order = np.argsort(u, kind="stable")
                    u, v = u[order], v[order] + 0.0
                    head, first, n = np.unique(u >> np.uint64(64 - bits - BITS), return_index=True, return_counts=True)
                    if len(head):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(head), k, np.int32)), pa.array(head.view(np.int64)), pa.array(n), pa.array(v[first]), pa.array(v[first + n - 1])], ["k", "p", "n", "low", "high"])

        found = rows.mapInArrow(run, "k int, p long, n long, low double, high double").groupBy("k", "p").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        out: dict[int, list[tuple[int, int, float, float]]] = {k: [] for k in range(len(names))}
        for r in found.collect():
            out[r["k"]].append((r["p"] % (1 << 64), r["n"], r["low"], r["high"]))
        return {k: sorted(v) for k, v in out.items()}

    # Of each column: a rank's value, or the prefix that it lies in and its rank there.
    values: list[dict[int, float]] = [{} for _ in names]
    sizes, todo = [0] * len(names), [{} for _ in names]
    for bits in range(0, 64, BITS):
        got = counted([sorted({p for p, _ in t.values()}) for t in todo], bits)
        for k in range(len(names)):
            if not bits:
                sizes[k] = sum(n for _, n, _, _ in got[k])
                todo[k] = {r: (0, r) for q in at for r in (math.floor(q * (sizes[k] - 1)), math.ceil(q * (sizes[k] - 1))) if sizes[k]}
            groups: dict[int, list[tuple[int, int, float, float]]] = {}
            for g in got[k]:
                groups.setdefault(g[0] >> BITS if bits else 0, []).append(g)
            for r, (prefix, left) in list(todo[k].items()):
                for p, n, low, high in groups[prefix]:
                    if left < n:
                        break
                    left -= n
                todo[k][r] = p, left
                if low == high or bits + BITS == 64:
                    values[k][r] = low
                    del todo[k][r]
        if not any(todo):
            break

    def between(k: int, q: float) -> float | None:
        if not sizes[k]:
            return None
        position = q * (sizes[k] - 1)
        low, high = math.floor(position), math.ceil(position)
        a, b = values[k][low], values[k][high]
        return a if low == high or a == b else (high - position) * a + (position - low) * b

    return {c: [between(k, q) for q in at] for k, c in enumerate(names)}
