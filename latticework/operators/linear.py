"""Linear models. Whatever depends on the rows only through sums of products reads them once (``stats.gram``);
gradient methods aggregate one gradient an iteration over a cached table, of p x classes numbers a task."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import validation as V
from ..functions import vectors
from ..functions.sums import total
from .stats import gram


def _num(c: str) -> Column:
    return F.col(c).cast("double")


@dataclass(frozen=True)
class LinearModel:
    cols: list[str]
    coefficients: np.ndarray
    intercept: float

    def column(self) -> Column:
        return sum((_num(c) * F.lit(float(w)) for c, w in zip(self.cols, self.coefficients)), F.lit(float(self.intercept)))

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.column())


def _centered(df: DataFrame, cols: list[str], y: str, weight: str | None, intercept: bool):
    s = gram(df, [*cols, V.target(df, y)], weight)[None]
    m = s.mean if intercept else np.zeros(len(cols) + 1)
    c = s.second - np.outer(m, s.first) - np.outer(s.first, m) + s.weight * np.outer(m, m)
    return s, c[:-1, :-1], c[:-1, -1], c[-1, -1], m[:-1], m[-1]


def set_intercept(coef: np.ndarray, x_mean: np.ndarray, y_mean: float, fit_intercept: bool) -> float:
    return float(y_mean - x_mean @ coef) if fit_intercept else 0.0


class LinearRegression:
    """Least squares of least norm."""

    @staticmethod
    def fit(df: DataFrame, cols: list[str], y: str, weight: str | None = None, fit_intercept: bool = True) -> LinearModel:
        _, xx, xy, _, mx, my = _centered(df, cols, y, weight, fit_intercept)
        scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
        coef = np.linalg.pinv(xx / np.outer(scale, scale), rcond=1e-12, hermitian=True) @ (xy / scale) / scale
        return LinearModel(cols, coef, set_intercept(coef, mx, my, fit_intercept))


class RidgeRegression:
    @staticmethod
    def fit(df: DataFrame, cols: list[str], y: str, alpha: float = 1.0, weight: str | None = None, fit_intercept: bool = True, solver: str = "svd") -> LinearModel:
        """"svd" leaves directions of no spread out, "cholesky" solves the normal equations."""
        V.one_of(solver, ("svd", "cholesky"))
        V.non_negative_number(alpha)
        _, xx, xy, _, mx, my = _centered(df, cols, y, weight, fit_intercept)
        if solver == "cholesky":
            coef = np.linalg.solve(xx + alpha * np.eye(len(cols)), xy)
        else:
            values, v = np.linalg.eigh(xx)
            keep = np.sqrt(np.maximum(values, 0)) > 1e-15
            coef = v[:, keep] @ ((v[:, keep].T @ xy) / (values[keep] + alpha))
        return LinearModel(cols, coef, set_intercept(coef, mx, my, fit_intercept))


def polynomial_terms(n: int, degree: int, fit_intercept: bool = True) -> list[tuple[int, ...]]:
    """Monomials as tuples of columns, by degree and then in order."""
    out: list[tuple[int, ...]] = [()] if fit_intercept else []
    for d in range(1, degree + 1):
        out += itertools.combinations_with_replacement(range(n), d)
    return out


class PolynomialRegression:
    @staticmethod
    def transform(df: DataFrame, cols: list[str], degree: int = 2, fit_intercept: bool = True, prefix: str = "poly") -> DataFrame:
        out = {}
        for k, term in enumerate(polynomial_terms(len(cols), V.positive_integer(degree), fit_intercept)):
            e = F.lit(1.0)
            for j in term:
                e = e * _num(cols[j])
            out[f"{prefix}{k}"] = e
        return df.withColumns(out)

    @staticmethod
    def fit(df: DataFrame, cols: list[str], y: str, degree: int = 2, weight: str | None = None, fit_intercept: bool = True) -> PolynomialModel:
        names = [f"lw_poly{k}" for k in range(len(polynomial_terms(len(cols), degree, False)))]
        wide = PolynomialRegression.transform(df, cols, degree, False, "lw_poly")
        return PolynomialModel(cols, degree, LinearRegression.fit(wide, names, y, weight, fit_intercept))


@dataclass(frozen=True)
class PolynomialModel:
    cols: list[str]
    degree: int
    linear: LinearModel

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        wide = PolynomialRegression.transform(df, self.cols, self.degree, False, "lw_poly")
        return self.linear.predict(wide, output).drop(*self.linear.cols)


@dataclass(frozen=True)
class BayesianRidgeModel(LinearModel):
    alpha: float = 0.0
    lambda_: float = 0.0
    sigma: np.ndarray | None = None
    iterations: int = 0
    scores: tuple[float, ...] = ()


class BayesianRidgeRegression:
    """Evidence maximisation on the sums of products: rows are read once, the iterations are p x p."""

    @staticmethod
    def fit(df: DataFrame, cols: list[str], y: str, iterations: int = 300, weight: str | None = None, fit_intercept: bool = True, alpha_init: float | None = None, lambda_init: float = 1.0, alpha_1: float = 1e-6, alpha_2: float = 1e-6, lambda_1: float = 1e-6, lambda_2: float = 1e-6, eps: float = 1e-8, compute_scores: bool = False) -> BayesianRidgeModel:
        s, xx, xy, yy, mx, my = _centered(df, cols, y, weight, fit_intercept)
        n, p = s.n, len(cols)
        values, v = np.linalg.eigh(xx)
        values, q = np.maximum(values, 0), v.T @ xy
        alpha, lam = alpha_init if alpha_init is not None else 1 / (yy / n + np.finfo(float).eps), lambda_init
        coef, scores, k = np.zeros(p), [], 0
        for k in range(1, iterations + 1):
            z = q / (values + lam / alpha)
            old, coef = coef, v @ z
            rss = float(yy - 2 * coef @ xy + coef @ xx @ coef)
            if compute_scores:
                scores.append(0.5 * (p * np.log(lam) + n * np.log(alpha) - alpha * rss - lam * coef @ coef - np.log(lam + alpha * values).sum() - n * np.log(2 * np.pi)) + lambda_1 * np.log(lam) - lambda_2 * lam + alpha_1 * np.log(alpha) - alpha_2 * alpha)
            gamma = float((alpha * values / (lam + alpha * values)).sum())
            lam = (gamma + 2 * lambda_1) / (float(coef @ coef) + 2 * lambda_2)
            alpha = (n - gamma + 2 * alpha_1) / (rss + 2 * alpha_2)
            if k > 1 and np.abs(coef - old).sum() < eps:
                break
        coef = v @ (q / (values + lam / alpha))
        sigma = v @ np.diag(1 / (alpha * values + lam)) @ v.T
        return BayesianRidgeModel(cols, coef, set_intercept(coef, mx, my, fit_intercept), alpha, lam, sigma, k, tuple(map(float, scores)))


# Isotonic regression.


@dataclass(frozen=True)
class IsotonicModel:
    """Thresholds (x rising, y) of a piecewise linear function; x outside is clipped or NaN."""

    x: np.ndarray
    y: np.ndarray
    increasing: bool
    out_of_bounds: str = "clip"

    def preprocess(self, trim_duplicates: bool = True) -> IsotonicModel:
        """Without the inner points of flat parts."""
        if not trim_duplicates or len(self.x) < 3:
            return self
        keep = np.ones(len(self.y), bool)
        keep[1:-1] = (self.y[1:-1] != self.y[:-2]) | (self.y[1:-1] != self.y[2:])
        return IsotonicModel(self.x[keep], self.y[keep], self.increasing, self.out_of_bounds)

    def predict(self, df: DataFrame, x: str, output: str = "prediction") -> DataFrame:
        from .interpolation import LinearInterpolation

        low, high = float(self.x[0]), float(self.x[-1])
        inside = df.withColumn("lw_x", F.least(F.lit(high), F.greatest(F.lit(low), _num(x))))
        out = LinearInterpolation.from_points(self.x, self.y).predict(inside, "lw_x", output)
        if self.out_of_bounds == "nan":
            out = out.withColumn(output, F.when((_num(x) < low) | (_num(x) > high), F.lit(float("nan"))).otherwise(F.col(output)))
        return out.drop("lw_x")


def pool_adjacent(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted means of adjacent points so that they don't fall."""
    means: list[list[float]] = []
    for a, b in zip(y.tolist(), w.tolist()):
        means.append([a, b, 1])
        while len(means) > 1 and means[-2][0] >= means[-1][0]:
            (m1, w1, n1), (m2, w2, n2) = means[-2], means[-1]
            means[-2:] = [[(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2]]
    return np.repeat([m for m, _, _ in means], [n for _, _, n in means])


class IsotonicRegression:
    """Monotone fit. Rows are averaged a distinct x by Spark; pooling runs over ranges of x in tasks first, which
    leaves only blocks, and then over the blocks of all ranges on the driver."""

    @staticmethod
    def fit(df: DataFrame, x: str, y: str, weight: str | None = None, y_min: float | None = None, y_max: float | None = None, increasing: str | bool = "auto", out_of_bounds: str = "clip") -> IsotonicModel:
        V.one_of(out_of_bounds, ("clip", "nan"))
        V.one_of(increasing, ("auto", True, False))
        w = V.weight_column(weight)
        g = df.groupBy(_num(x).alias("x")).agg((F.sum(w * _num(y)) / F.sum(w)).alias("y"), F.sum(w).alias("w"))
        if increasing == "auto":
            increasing = df.select(F.covar_pop(_num(x), _num(y))).first()[0] >= 0
        sign = 1.0 if increasing else -1.0

        def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Batches of a partition come by rising x; of a pooled block, its first and last x matter.
            blocks: list[list[float]] = []
            for b in batches:
                for a, v, u in zip(*(b.column(k).to_pylist() for k in range(3))):
                    blocks.append([a, a, v * sign, u])
                    while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
                        l, r = blocks[-2], blocks[-1]
                        blocks[-2:] = [[l[0], r[1], (l[2] * l[3] + r[2] * r[3]) / (l[3] + r[3]), l[3] + r[3]]]
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*blocks)], ["lo", "hi", "v", "w"])

        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = g.select("x", "y", "w").repartitionByRange(n, "x").sortWithinPartitions("x").mapInArrow(pool, "lo double, hi double, v double, w double").toArrow().sort_by("lo")
        lo, hi, v, ws = (blocks[c].to_numpy() for c in ("lo", "hi", "v", "w"))
        fitted = pool_adjacent(v, ws) * sign
        if y_min is not None or y_max is not None:
            fitted = np.clip(fitted, y_min, y_max)
        two = hi > lo
        xs, ys = np.concatenate([lo, hi[two]]), np.concatenate([fitted, fitted[two]])
        order = np.argsort(xs, kind="stable")
        return IsotonicModel(xs[order], ys[order], bool(increasing), out_of_bounds).preprocess()


# Gradient methods.


@dataclass(frozen=True)
class LinearClassifier:
    """Scores x W + b, a column of W a class."""

    cols: list[str]
    coefficients: np.ndarray
    bias: np.ndarray
    iterations: int = 0

    def scores(self) -> Column:
        return F.array(*[sum((_num(c) * F.lit(float(self.coefficients[j, k])) for j, c in enumerate(self.cols)), F.lit(float(self.bias[k]))) for k in range(len(self.bias))])

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, vectors.argmax_index(self.scores()))

    def predict_probability(self, df: DataFrame, output: str = "probability") -> DataFrame:
        return df.withColumn(output, vectors.softmax(self.scores()))


def _total(df: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``fn(x, y)`` over the Arrow batches of (x array, y) of a table that is kept."""
    return total(df, lambda b: fn(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), b.column(1).to_numpy(zero_copy_only=False)), df.rdd.getNumPartitions())


def _table(df: DataFrame, cols: list[str], y: str) -> DataFrame:
    return df.select(F.array(*[_num(c) for c in cols]).alias("x"), _num(V.target(df, y)).alias("y")).cache()


class LogisticRegression:
    """Softmax regression: mean cross-entropy plus alpha times the squared weights (biases are free), by gradient descent with backtracking."""

    @staticmethod
    def fit(df: DataFrame, cols: list[str], y: str, num_classes: int, max_iterations: int = 1000, alpha: float = 1.0, tol: float = 1e-4) -> LinearClassifier:
        V.non_negative_number(alpha)
        p, k = len(cols), V.positive_integer(num_classes)
        table = _table(df, cols, y)
        try:
            n = table.count()

            def at(theta: np.ndarray, steps: np.ndarray | None = None, direction: np.ndarray | None = None) -> np.ndarray:
                """Loss and gradient; or losses along a direction at several steps, in one pass."""

                def part(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
                    rows, t = np.arange(len(x)), labels.astype(int)

                    def loss(th: np.ndarray) -> tuple[float, np.ndarray]:
                        z = x @ th[:p] + th[p]
                        z = z - z.max(1, keepdims=True)
                        e = np.exp(z)
                        s = e.sum(1)
                        return float((np.log(s) - z[rows, t]).sum()), e / s[:, None]

                    if steps is not None:
                        return np.array([loss(theta + u * direction)[0] for u in steps])
                    value, prob = loss(theta)
                    prob[rows, t] -= 1
                    return np.concatenate([[value], (x.T @ prob).ravel(), prob.sum(0)])

                return _total(table, part) / n

            theta = np.zeros((p + 1, k))
            penalty = lambda th: alpha * float((th[:p] ** 2).sum())
            done = 0
            for done in range(1, max_iterations + 1):
                s = at(theta)
                g = np.vstack([s[1 : 1 + p * k].reshape(p, k) + 2 * alpha * theta[:p], s[1 + p * k :]])
                if np.abs(g).max() <= tol:
                    break
                value, slope = s[0] + penalty(theta), float((g * g).sum())
                step = None
                for first in range(0, 40, 8):  # eight halvings a pass
                    steps = 0.5 ** np.arange(first, first + 8)
                    tried = at(theta, steps, -g)
                    ok = [u for u, v in zip(steps, tried) if v + penalty(theta - u * g) <= value - 1e-4 * u * slope]
                    if ok:
                        step = ok[0]
                        break
                if step is None:
                    break
                theta = theta - step * g
            return LinearClassifier(cols, theta[:p], theta[p], done)
        finally:
            table.unpersist()


def hinge_loss(scores: np.ndarray, targets: np.ndarray, c: float = 1.0, margin: float = 10.0) -> float:
    """c times the sum of max(0, margin - score) over the positive targets."""
    return float(c * (np.maximum(0, margin - scores) * targets).sum())


class SVM:
    """One class against the rest, by gradient descent on the mean hinge loss: scores under +margin of the own class and over -margin of the others cost."""

    @staticmethod
    def fit(df: DataFrame, cols: list[str], y: str, num_classes: int, iterations: int = 1000, learning_rate: float = 0.01, margin: float = 1.0, eps: float = 1e-8, optimizer: object = "sgd") -> LinearClassifier:
        V.optimizer(optimizer)
        p, k = len(cols), V.positive_integer(num_classes)
        table = _table(df, cols, y)
        try:
            n = table.count()
            theta, state, last, done = np.zeros((p + 1, k)), {}, np.inf, 0
            for done in range(1, iterations + 1):

                def part(x: np.ndarray, labels: np.ndarray, theta: np.ndarray = theta) -> np.ndarray:
                    sign = np.where(labels.astype(int)[:, None] == np.arange(k), 1.0, -1.0)
                    short = margin - sign * (x @ theta[:p] + theta[p])
                    g = np.where(short > 0, -sign, 0.0)
                    return np.concatenate([[np.maximum(short, 0).sum()], (x.T @ g).ravel(), g.sum(0)])

                s = _total(table, part) / n
                theta = theta + optimizer_step(optimizer, s[1:].reshape(p + 1, k), state, learning_rate)
                if abs(last - s[0]) < eps:
                    break
                last = s[0]
            return LinearClassifier(cols, theta[:p], theta[p], done)
        finally:
            table.unpersist()


def optimizer_step(kind: object, g: np.ndarray, state: dict, rate: float) -> np.ndarray:
    """The update of a gradient ``g``; ``state`` is kept between calls."""
    if isinstance(kind, tuple):
        init, update = kind
        state.setdefault("s", init(g))
        step, state["s"] = update(g, state["s"])
        return step
    t = state["t"] = state.get("t", 0) + 1
    if kind == "momentum":
        state["m"] = 0.9 * state.get("m", 0) + g
        return -rate * state["m"]
    if kind == "adam":
        state["m"] = 0.9 * state.get("m", 0) + 0.1 * g
        state["v"] = 0.999 * state.get("v", 0) + 0.001 * g * g
        return -rate * (state["m"] / (1 - 0.9**t)) / (np.sqrt(state["v"] / (1 - 0.999**t)) + 1e-8)
    if kind == "adagrad":
        state["v"] = state.get("v", 0) + g * g
        return -rate * g / (np.sqrt(state["v"]) + 1e-8)
    if kind == "rmsprop":
        state["v"] = 0.9 * state.get("v", 0) + 0.1 * g * g
        return -rate * g / (np.sqrt(state["v"]) + 1e-8)
    return -rate * g
