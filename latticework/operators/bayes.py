"""Naive Bayes and discriminant analysis: class sums in one aggregation, scores as projections."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validation as V
from ..functions import vectors
from .stats import gram


def _num(c: str) -> Column:
    return F.col(c).cast("double")


class ScoreModel:
    """Joint log-likelihoods as an array column, in the order of ``classes``."""

    classes: list

    def joint(self) -> Column:
        raise NotImplementedError

    def predict_joint_log_probability(self, df: DataFrame, output: str = "jll") -> DataFrame:
        return df.withColumn(output, self.joint())

    def predict_log_probability(self, df: DataFrame, output: str = "log_probability") -> DataFrame:
        j = self.joint()
        shift = vectors.logsumexp(j)
        return df.withColumn(output, F.transform(j, lambda v: v - shift))

    def predict_probability(self, df: DataFrame, output: str = "probability") -> DataFrame:
        return df.withColumn(output, vectors.softmax(self.joint()))

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """The first class of the highest score."""
        return df.withColumn(output, F.element_at(F.array(*[F.lit(c) for c in self.classes]), vectors.argmax_index(self.joint()) + 1))


def _linear(cols: list[str], weights: np.ndarray, base: np.ndarray) -> Column:
    """base[c] + sum of weights[c, j] x_j as an array."""
    x = vectors.pack(cols)
    return F.array(*[F.lit(float(b)) + vectors.dot_literal(x, row.tolist()) for row, b in zip(weights, base)])


def _class_sums(df: DataFrame, cols: list[str], y: str, weight: str | None, exprs: dict[str, object] | None = None) -> tuple[list, np.ndarray, np.ndarray]:
    """(classes, weight of each, weighted sums a class and column)."""
    w = V.weight_column(weight)
    rows = df.groupBy(F.col(y).alias("y")).agg(F.sum(w).alias("n"), F.array(*[F.sum(w * _num(c)) for c in cols]).alias("s")).where("y is not null").orderBy("y").collect()
    return [r["y"] for r in rows], np.array([r["n"] for r in rows]), np.array([r["s"] for r in rows])


def _prior(n: np.ndarray, fit_priors: bool, given: list[float] | None) -> np.ndarray:
    if given is not None:
        if len(given) != len(n):
            raise ValueError(f"{len(given)} priors for {len(n)} classes")
        return np.log(np.array(given, float))
    return np.log(n / n.sum()) if fit_priors else np.full(len(n), -np.log(len(n)))


def _alpha(alpha: float | list[float], force: bool) -> np.ndarray:
    a = np.asarray(alpha, float)
    if (a < 0).any():
        raise ValueError("alpha must not be negative")
    return a if force else np.maximum(a, 1e-10)


@dataclass(frozen=True)
class GaussianNBModel(ScoreModel):
    cols: list[str]
    classes: list
    log_prior: np.ndarray
    mean: np.ndarray
    variance: np.ndarray

    def joint(self) -> Column:
        out = []
        for c in range(len(self.classes)):
            base = self.log_prior[c] - 0.5 * float(np.log(2 * np.pi * self.variance[c]).sum())
            far = [(_num(x) - F.lit(float(m))) * (_num(x) - F.lit(float(m))) * F.lit(float(0.5 / v)) for x, m, v in zip(self.cols, self.mean[c], self.variance[c])]
            while len(far) > 1:
                far = [far[k] + far[k + 1] if k + 1 < len(far) else far[k] for k in range(0, len(far), 2)]
            out.append(F.lit(float(base)) - far[0])
        return F.array(*out)


class GaussianNB:
    @staticmethod
    def fit(df: DataFrame, cols: list[str], y: str, var_smoothing: float = 1e-9, priors: list[float] | None = None, weight: str | None = None) -> GaussianNBModel:
        s = gram(df, cols, weight, y)
        classes = list(s)
        mean = np.array([s[c].mean for c in classes])
        var = np.array([np.maximum(np.diag(s[c].covariance()), 0) for c in classes])
        row = df.agg(*[F.var_pop(_num(c)) for c in cols]).first()
        n = np.array([s[c].weight for c in classes])
        return GaussianNBModel(cols, classes, _prior(n, True, priors), mean, var + var_smoothing * max(row))


@dataclass(frozen=True)
class LinearScoreModel(ScoreModel):
    cols: list[str]
    classes: list
    base: np.ndarray
    weights: np.ndarray

    def joint(self) -> Column:
        return _linear(self.cols, self.weights, self.base)


class MultinomialNB:
    @staticmethod
    def fit(df: DataFrame, cols: list[str], y: str, alpha: float | list[float] = 1.0, force_alpha: bool = True, fit_priors: bool = True, class_priors: list[float] | None = None, weight: str | None = None) -> LinearScoreModel:
        classes, n, s = _class_sums(df, cols, y, weight)
        s = s + _alpha(alpha, force_alpha)
        return LinearScoreModel(cols, classes, _prior(n, fit_priors, class_priors), np.log(s) - np.log(s.sum(1, keepdims=True)))


class ComplementNB:
    @staticmethod
    def fit(df: DataFrame, cols: list[str], y: str, alpha: float | list[float] = 1.0, force_alpha: bool = True, fit_priors: bool = True, priors: list[float] | None = None, weight: str | None = None, norm: bool = False) -> LinearScoreModel:
        """The prior counts only if there is one class."""
        classes, n, s = _class_sums(df, cols, y, weight)
        rest = s.sum(0) + _alpha(alpha, force_alpha) - s
        logged = np.log(rest / rest.sum(1, keepdims=True))
        w = logged / logged.sum(1, keepdims=True) if norm else -logged
        return LinearScoreModel(cols, classes, _prior(n, fit_priors, priors) if len(classes) == 1 else np.zeros(len(classes)), w)


class BernoulliNB:
    @staticmethod
    def fit(df: DataFrame, cols: list[str], y: str, alpha: float | list[float] = 1.0, force_alpha: bool = True, binarize: float | None = 0.0, fit_priors: bool = True, class_priors: list[float] | None = None, weight: str | None = None) -> LinearScoreModel:
        """``binarize`` is for fitting; rows to predict are taken as they are (0 or 1)."""
        x = df if binarize is None else df.withColumns({c: (_num(c) > F.lit(binarize)).cast("double") for c in cols})
        classes, n, s = _class_sums(x, cols, y, weight)
        a = _alpha(alpha, force_alpha)
        p = np.log(s + a) - np.log(n[:, None] + 2 * a)
        q = np.log1p(-np.exp(p))
        return LinearScoreModel(cols, classes, _prior(n, fit_priors, class_priors) + q.sum(1), p - q)


@dataclass(frozen=True)
class CategoricalNBModel(ScoreModel):
    cols: list[str]
    classes: list
    log_prior: np.ndarray
    tables: list[np.ndarray]  # a column: class x category

    def joint(self) -> Column:
        out = []
        for c in range(len(self.classes)):
            e = F.lit(float(self.log_prior[c]))
            for x, t in zip(self.cols, self.tables):
                e = e + F.element_at(F.array(*[F.lit(float(v)) for v in t[c]]), F.col(x).cast("int") + 1)
            out.append(e)
        return F.array(*out)


class CategoricalNB:
    @staticmethod
    def fit(df: DataFrame, cols: list[str], y: str, alpha: float = 1.0, force_alpha: bool = True, fit_priors: bool = True, class_priors: list[float] | None = None, weight: str | None = None, min_categories: list[int] | None = None) -> CategoricalNBModel:
        """Columns hold categories 0, 1, ...; counts of (column, class, category) in one aggregation."""
        a, w = float(_alpha(alpha, force_alpha)), V.weight_column(weight)
        classes, n, _ = _class_sums(df, cols[:1], y, weight)
        cells = df.select(F.col(y).alias("y"), w.alias("w"), F.posexplode(F.array(*[F.col(c).cast("int") for c in cols])).alias("j", "v"))
        rows = cells.groupBy("j", "y", "v").agg(F.sum("w").alias("n")).where("v is not null").collect()
        sizes = [max([r["v"] + 1 for r in rows if r["j"] == j] + ([min_categories[j]] if min_categories else [1])) for j in range(len(cols))]
        tables = [np.full((len(classes), m), a) for m in sizes]
        at = {c: k for k, c in enumerate(classes)}
        for r in rows:
            if r["y"] in at:
                tables[r["j"]][at[r["y"]], r["v"]] += r["n"]
        return CategoricalNBModel(cols, classes, _prior(n, fit_priors, class_priors), [np.log(t) - np.log(t.sum(1, keepdims=True)) for t in tables])


class LinearDiscriminant:
    """Gaussian classes of one covariance, pooled over n - number of classes."""

    @staticmethod
    def fit(df: DataFrame, cols: list[str], y: str) -> LinearScoreModel:
        s = gram(df, cols, None, y)
        classes = list(s)
        n = np.array([s[c].weight for c in classes])
        means = np.array([s[c].mean for c in classes])
        pooled = sum(s[c].covariance() * s[c].weight for c in classes) / (n.sum() - len(classes))
        w = np.linalg.solve(pooled, means.T).T
        return LinearScoreModel(cols, classes, np.log(n / n.sum()) - 0.5 * (w * means).sum(1), w)


@dataclass(frozen=True)
class QuadraticModel(ScoreModel):
    cols: list[str]
    classes: list
    log_prior: np.ndarray
    means: np.ndarray
    rotations: list[np.ndarray]
    scalings: list[np.ndarray]

    def joint(self) -> Column:
        x = vectors.pack(self.cols)
        out = []
        for c in range(len(self.classes)):
            # (x - m) R / sqrt(s), squared and summed, as inner products with constants.
            m = self.rotations[c] / np.sqrt(self.scalings[c])
            offset = self.means[c] @ m
            parts = [vectors.dot_literal(x, m[:, k].tolist()) - F.lit(float(offset[k])) for k in range(m.shape[1])]
            far = vectors.total(F.transform(F.array(*parts), lambda v: v * v))
            out.append(F.lit(float(self.log_prior[c] - 0.5 * np.log(self.scalings[c]).sum())) - far * 0.5)
        return F.array(*out)

    decision_function = ScoreModel.predict_joint_log_probability


class QuadraticDiscriminant:
    @staticmethod
    def fit(df: DataFrame, cols: list[str], y: str, reg_param: float = 0.0) -> QuadraticModel:
        """Variances along each class's own axes, shrunk to 1 by ``reg_param``."""
        s = gram(df, cols, None, y)
        classes = list(s)
        n = np.array([s[c].weight for c in classes])
        rotations, scalings = [], []
        for c in classes:
            values, r = np.linalg.eigh(s[c].covariance(1))
            rotations.append(r)
            scalings.append((1 - reg_param) * np.maximum(values, 0) + reg_param)
        return QuadraticModel(cols, classes, np.log(n / n.sum()), np.array([s[c].mean for c in classes]), rotations, scalings)
