"""Principal components and relatives. Sums of products come from one aggregation; the algebra is p x p.

Kernel PCA multiplies by its n x n kernel slice by slice and never holds it; the driver and tasks hold n x p numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validation as V
from ..functions import vectors
from .neighbors import _matrix
from .slices import CELLS, Slices, largest
from .stats import gram


def _num(c: str) -> Column:
    return F.col(c).cast("double")


def project(cols: list[str], components: np.ndarray, offset: np.ndarray) -> Column:
    """Array of components @ x - components @ offset."""
    x = vectors.pack(cols)
    return F.array(*[vectors.dot_literal(x, c.tolist()) - F.lit(float(c @ offset)) for c in components])


def flip(u: np.ndarray, v: np.ndarray, u_based: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Signs fixed so that the entry of largest size in each column of u (or row of v) is positive."""
    lead = u[np.abs(u).argmax(0), np.arange(u.shape[1])] if u_based else v[np.arange(len(v)), np.abs(v).argmax(1)]
    sign = np.where(lead < 0, -1.0, 1.0)
    return u * sign, v * sign[:, None]


def _signs(df: DataFrame, cols: list[str], components: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Signs that make the projection of largest size positive for each component: one aggregation."""
    z = project(cols, components, offset)
    tops = [F.max(F.struct(F.abs(z[k]).alias("a"), z[k].alias("v"))).alias(f"k{k}") for k in range(len(components))]
    row = df.agg(*tops).first()
    return np.array([-1.0 if r["v"] < 0 else 1.0 for r in row])


@dataclass(frozen=True)
class PCAModel:
    cols: list[str]
    components: np.ndarray
    singular_values: np.ndarray
    explained_variance: np.ndarray
    explained_variance_ratio: np.ndarray
    mean: np.ndarray
    n: int
    whiten: bool = False
    scatter: np.ndarray | None = None

    def transform(self, df: DataFrame, output: str = "pca") -> DataFrame:
        c = self.components / np.sqrt(self.explained_variance)[:, None] if self.whiten else self.components
        return df.withColumn(output, project(self.cols, c, self.mean))


class PCA:
    @staticmethod
    def fit(df: DataFrame, cols: list[str], num_components: int, whiten: bool = False) -> PCAModel:
        s = gram(df, cols)[None]
        model = PCA._solve(cols, s.covariance() * s.weight, s.mean, s.n, V.positive_integer(num_components), whiten)
        sign = _signs(df, cols, model.components, model.mean)
        return replace(model, components=model.components * sign[:, None])

    @staticmethod
    def _solve(cols: list[str], scatter: np.ndarray, mean: np.ndarray, n: int, k: int, whiten: bool) -> PCAModel:
        if k > min(n, len(cols)):
            raise ValueError(f"{k} components of {n} rows and {len(cols)} columns")
        values, v = np.linalg.eigh(scatter)
        values, v = np.maximum(values[::-1], 0), v[:, ::-1].T
        var = values / (n - 1)
        return PCAModel(cols, v[:k], np.sqrt(values[:k]), var[:k], var[:k] / var.sum(), mean, n, whiten, scatter)

    @staticmethod
    def fit_transform(df: DataFrame, cols: list[str], num_components: int, whiten: bool = False, output: str = "pca") -> DataFrame:
        return PCA.fit(df, cols, num_components, whiten).transform(df, output)

    @staticmethod
    def partial_fit(model: PCAModel, batch: DataFrame) -> PCAModel:
        """The model with one batch more. Scatter matrices add up exactly, with a term for the shift of the mean."""
        s = gram(batch, model.cols)[None]
        n = model.n + s.n
        shift = s.mean - model.mean
        scatter = model.scatter + s.covariance() * s.weight + np.outer(shift, shift) * (model.n * s.n / n)
        mean = model.mean + shift * (s.n / n)
        new = PCA._solve(model.cols, scatter, mean, n, len(model.components), model.whiten)
        _, components = flip(np.eye(len(new.components)), new.components, False)
        return replace(new, components=components)

    @staticmethod
    def incremental_fit(batches, cols: list[str], num_components: int, whiten: bool = False) -> PCAModel:
        """Over an iterable of frames; with Structured Streaming, call ``partial_fit`` from ``foreachBatch``."""
        first, *rest = list(batches)
        return reduce(PCA.partial_fit, rest, PCA.fit(first, cols, num_components, whiten))


@dataclass(frozen=True)
class SVDModel:
    cols: list[str]
    components: np.ndarray
    singular_values: np.ndarray
    explained_variance: np.ndarray
    explained_variance_ratio: np.ndarray

    def transform(self, df: DataFrame, output: str = "svd") -> DataFrame:
        return df.withColumn(output, project(self.cols, self.components, np.zeros(len(self.cols))))


def randomized_range_finder(a: np.ndarray, size: int, num_iter: int = 5, seed: int = 0) -> np.ndarray:
    """Orthonormal columns that nearly span those of ``a``."""
    q = np.linalg.qr(a @ np.random.default_rng(seed).standard_normal((a.shape[1], size)))[0]
    for _ in range(num_iter):
        q = np.linalg.qr(a @ np.linalg.qr(a.T @ q)[0])[0]
    return q


class TruncatedSVD:
    """Of the rows as they are, without centring; exact, from the p x p sums of products."""

    @staticmethod
    def fit(df: DataFrame, cols: list[str], num_components: int = 2) -> SVDModel:
        s = gram(df, cols)[None]
        values, v = np.linalg.eigh(s.second)
        values, v = np.maximum(values[::-1], 0)[:num_components], v[:, ::-1].T[:num_components]
        v = v * _signs(df, cols, v, np.zeros(len(cols)))[:, None]
        c = s.covariance()
        var = np.array([x @ c @ x for x in v])
        return SVDModel(cols, v, np.sqrt(values), var, var / np.trace(c))

    @staticmethod
    def fit_transform(df: DataFrame, cols: list[str], num_components: int = 2, output: str = "svd") -> DataFrame:
        return TruncatedSVD.fit(df, cols, num_components).transform(df, output)


def kernel_matrix(x: np.ndarray, y: np.ndarray, kernel: str, gamma: float, degree: int, coef0: float) -> np.ndarray:
    if kernel == "linear":
        return x @ y.T
    if kernel == "poly":
        return (gamma * (x @ y.T) + coef0) ** degree
    if kernel == "rbf":
        d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
        return np.exp(-gamma * np.maximum(d, 0))
    if kernel == "sigmoid":
        return np.tanh(gamma * (x @ y.T) + coef0)
    nx, ny = (np.where(n == 0, 1, n) for n in (np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)))
    return (x / nx[:, None]) @ (y / ny[:, None]).T


@dataclass(frozen=True)
class KernelPCAModel:
    cols: list[str]
    ids: np.ndarray
    x: np.ndarray
    eigenvalues: np.ndarray
    eigenvectors: np.ndarray
    means: np.ndarray
    mean: float
    options: tuple

    def _frame(self, df: DataFrame, id: str, make, output: str) -> DataFrame:
        k = len(self.eigenvalues)
        sent = df.sparkSession.sparkContext.broadcast(self)  # n x p numbers

        def run(batches):
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    step = max(1, CELLS // len(sent.value.x))
                    made = np.concatenate([make(sent.value, x[at : at + step]) for at in range(0, len(x), step)])
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), k).cast(pa.list_(pa.float64()))], ["id", output])

        return df.select(F.col(id).cast("long").alias("id"), vectors.pack(self.cols).alias("x")).mapInArrow(run, f"id long, `{output}` array<double>")

    def transform(self, df: DataFrame, id: str, output: str = "kpca") -> DataFrame:
        """(id, output)."""

        def make(m: KernelPCAModel, x: np.ndarray) -> np.ndarray:
            k = kernel_matrix(x, m.x, *m.options)
            k = k - k.mean(1, keepdims=True) - m.means[None, :] + m.mean
            return k @ (m.eigenvectors / np.sqrt(np.where(m.eigenvalues > 0, m.eigenvalues, np.inf)))

        return self._frame(df, id, make, output)


class KernelPCA:
    @staticmethod
    def fit(df: DataFrame, id: str, cols: list[str], num_components: int, kernel: str = "linear", gamma: float | None = None, degree: int = 3, coef0: float = 1.0) -> KernelPCAModel:
        V.one_of(kernel, ("linear", "poly", "rbf", "sigmoid", "cosine"))
        rows = df.select(F.col(id).alias("id"), vectors.pack(cols).alias("x")).orderBy("id").toArrow()
        x = _matrix(rows["x"])
        n, num_components = len(x), min(num_components, len(x))
        options = (kernel, gamma if gamma is not None else 1 / len(cols), degree, coef0)

        def part(x: np.ndarray, a: int, b: int, v: np.ndarray) -> np.ndarray:
            return kernel_matrix(x[a:b], x, *options) @ v

        with Slices(df.sparkSession, x) as slices:
            means = slices.each(part, np.full((n, 1), 1 / n))[:, 0]
            mean = float(means.mean())

            def centred(v: np.ndarray) -> np.ndarray:
                return slices.each(part, v) - np.outer(np.ones(n), means @ v) - np.outer(means - mean, v.sum(0))

            values, v = largest(centred, n, num_components)
        values = np.maximum(values, 0)
        v, _ = flip(v, np.eye(num_components))
        return KernelPCAModel(cols, rows["id"].to_numpy(), x, values, v, means, mean, options)

    @staticmethod
    def fit_transform(df: DataFrame, id: str, cols: list[str], num_components: int, output: str = "kpca", **opts) -> DataFrame:
        return KernelPCA.fit(df, id, cols, num_components, **opts).transform(df, id, output)


@dataclass(frozen=True)
class PLSModel:
    x_cols: list[str]
    y_cols: list[str]
    x_weights: np.ndarray
    y_weights: np.ndarray
    x_mean: np.ndarray
    y_mean: np.ndarray
    x_std: np.ndarray
    y_std: np.ndarray

    def transform(self, df: DataFrame, x_output: str = "x_scores", y_output: str = "y_scores") -> DataFrame:
        return df.withColumns({
            x_output: project(self.x_cols, self.x_weights.T / self.x_std[None, :], self.x_mean),
            y_output: project(self.y_cols, self.y_weights.T / self.y_std[None, :], self.y_mean),
        })


class PLSSVD:
    """Directions of largest covariance between two sets of columns."""

    @staticmethod
    def fit(df: DataFrame, x_cols: list[str], y_cols: list[str], num_components: int = 2, scale: bool = True) -> PLSModel:
        s = gram(df, [*x_cols, *y_cols])[None]
        c, p = s.covariance(1), len(x_cols)
        std = np.sqrt(np.diag(c)) if scale else np.ones(len(c))
        std = np.where(std == 0, 1, std)
        u, _, v = np.linalg.svd((c / np.outer(std, std))[:p, p:], full_matrices=False)
        u, v = flip(u, v)
        k = num_components
        return PLSModel(x_cols, y_cols, u[:, :k], v[:k].T, s.mean[:p], s.mean[p:], std[:p], std[p:])

    @staticmethod
    def fit_transform(df: DataFrame, x_cols: list[str], y_cols: list[str], num_components: int = 2, scale: bool = True) -> DataFrame:
        return PLSSVD.fit(df, x_cols, y_cols, num_components, scale).transform(df)
