"""Regression and ranking metrics: one aggregation each, two where a mean or quantile comes first."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import validation as V
from .stats import quantiles

EPS = sys.float_info.epsilon


def _pair(y: str, p: str) -> tuple[Column, Column]:
    return F.col(y).cast("double"), F.col(p).cast("double")


def _mean(e: Column, weight: str | None = None) -> Column:
    if weight is None:
        return F.avg(e)
    w = V.weight_column(weight)
    return F.sum(w * e) / F.sum(w)


def mean_absolute_error(df: DataFrame, y: str, p: str) -> DataFrame:
    t, q = _pair(y, p)
    return df.agg(F.avg(F.abs(t - q)).alias("mae"))


def mean_square_error(df: DataFrame, y: str, p: str) -> DataFrame:
    t, q = _pair(y, p)
    return df.agg(F.avg((t - q) * (t - q)).alias("mse"))


def mean_square_log_error(df: DataFrame, y: str, p: str) -> DataFrame:
    t, q = _pair(y, p)
    d = F.log1p(t) - F.log1p(q)
    return df.agg(F.avg(d * d).alias("msle"))


def mean_absolute_percentage_error(df: DataFrame, y: str, p: str) -> DataFrame:
    """Over max(eps, |y|) with the eps of doubles."""
    t, q = _pair(y, p)
    return df.agg(F.avg(F.abs(t - q) / F.greatest(F.lit(EPS), F.abs(t))).alias("mape"))


def max_residual_error(df: DataFrame, y: str, p: str) -> DataFrame:
    t, q = _pair(y, p)
    return df.agg(F.max(F.abs(t - q)).alias("max_error"))


def tweedie(t: Column, q: Column, power: float) -> Column:
    """Deviance of one row."""
    if power == 0:
        return (t - q) * (t - q)
    if power == 1:
        return 2 * (F.when(t == 0, 0.0).otherwise(t * F.log(t / q)) - t + q)
    if power == 2:
        return 2 * (F.log(q / t) + t / q - 1)
    a, b = 1 - power, 2 - power
    head = F.when(t > 0, F.pow(t, F.lit(float(b)))).otherwise(0.0) if power < 0 else F.pow(t, F.lit(float(b)))
    return 2 * (head / (a * b) - t * F.pow(q, F.lit(float(a))) / a + F.pow(q, F.lit(float(b))) / b)


def mean_tweedie_deviance(df: DataFrame, y: str, p: str, power: float) -> DataFrame:
    return df.agg(F.avg(tweedie(*_pair(y, p), power)).alias("deviance"))


def mean_tweedie_deviance_checked(df: DataFrame, y: str, p: str, power: float) -> DataFrame:
    """As above; values outside the domain of ``power`` raise, as does a power between 0 and 1."""
    if 0 < power < 1:
        raise ValueError(f"there is no deviance of power {power}")
    t, q = _pair(y, p)
    r = df.agg(F.min(t).alias("t"), F.min(q).alias("q")).first()
    bad = (power != 0 and r["q"] <= 0) or (1 <= power < 2 and r["t"] < 0) or (power >= 2 and r["t"] <= 0)
    if bad:
        raise ValueError(f"power {power} doesn't go with targets from {r['t']} and predictions from {r['q']}")
    return mean_tweedie_deviance(df, y, p, power)


def mean_poisson_deviance(df: DataFrame, y: str, p: str) -> DataFrame:
    return mean_tweedie_deviance(df, y, p, 1)


def mean_gamma_deviance(df: DataFrame, y: str, p: str) -> DataFrame:
    return mean_tweedie_deviance(df, y, p, 2)


def _explained(left: Column, spread: Column, force_finite: bool) -> Column:
    if not force_finite:
        return F.when(spread != 0, 1 - left / spread).when(left == 0, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    return F.when(left == 0, 1.0).when(spread == 0, 0.0).otherwise(1 - left / spread)


def r2_score(df: DataFrame, y: str, p: str, force_finite: bool = True) -> DataFrame:
    t, q = _pair(y, p)
    mean = df.agg(F.avg(t)).first()[0]
    s = df.agg(F.sum((t - q) * (t - q)).alias("l"), F.sum((t - F.lit(mean)) * (t - F.lit(mean))).alias("s"))
    return s.select(_explained(F.col("l"), F.col("s"), force_finite).alias("r2"))


def explained_variance_score(df: DataFrame, y: str, p: str, force_finite: bool = True) -> DataFrame:
    t, q = _pair(y, p)
    s = df.agg(F.var_pop(t - q).alias("l"), F.var_pop(t).alias("s"))
    return s.select(_explained(F.col("l"), F.col("s"), force_finite).alias("explained_variance"))


def d2_tweedie_score(df: DataFrame, y: str, p: str, power: float) -> DataFrame:
    """1 - deviance over that of the mean; NaN of fewer than two rows."""
    t, q = _pair(y, p)
    r = df.agg(F.avg(t).alias("m"), F.count(t).alias("n")).first()
    if r["n"] < 2:
        return df.sparkSession.createDataFrame([(float("nan"),)], "d2 double")
    s = df.agg(F.avg(tweedie(t, q, power)).alias("a"), F.avg(tweedie(t, F.lit(r["m"]), power)).alias("b"))
    return s.select((1 - F.col("a") / F.col("b")).alias("d2"))


def _pinball(t: Column, q: Column, alpha: float) -> Column:
    d = t - q
    return F.when(d >= 0, F.lit(float(alpha)) * d).otherwise(F.lit(float(alpha) - 1) * d)


def mean_pinball_loss(df: DataFrame, y: str, p: str, alpha: float = 0.5, weight: str | None = None) -> DataFrame:
    return df.agg(_mean(_pinball(*_pair(y, p), alpha), weight).alias("pinball"))


def quantile(df: DataFrame, column: str, q: float) -> float:
    """Exact, by linear interpolation."""
    return quantiles(df, {column: F.col(column)}, [q])[column][0]


def d2_pinball_score(df: DataFrame, y: str, p: str, alpha: float = 0.5, weight: str | None = None) -> DataFrame:
    """1 - pinball loss over that of the alpha-quantile of the targets."""
    t, q = _pair(y, p)
    at = quantile(df, y, alpha)
    s = df.agg(_mean(_pinball(t, q, alpha), weight).alias("a"), _mean(_pinball(t, F.lit(at), alpha), weight).alias("b"))
    return s.select(F.when(F.col("b") == 0, F.when(F.col("a") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("a") / F.col("b")).alias("d2"))


def d2_absolute_error_score(df: DataFrame, y: str, p: str, weight: str | None = None) -> DataFrame:
    return d2_pinball_score(df, y, p, 0.5, weight)


def dcg(df: DataFrame, relevance: str, score: str, k: int | None = None, query: list[str] | None = None) -> DataFrame:
    """Discounted gain of each ``query``'s ranking (of all rows where there is none), by falling score, then relevance."""
    keys = query or []
    rank = F.row_number().over(W.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy(F.desc(score), F.desc(relevance)))
    s = df.select(*keys, F.col(relevance).cast("double").alias("rel"), rank.alias("rank"))
    if k is not None:
        s = s.where(F.col("rank") <= k)
    gain = F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg")
    return s.groupBy(*keys).agg(gain) if keys else s.agg(gain)


def ndcg(df: DataFrame, relevance: str, score: str, k: int | None = None, query: list[str] | None = None) -> DataFrame:
    """Over the gain of the best ranking; 0 where that is 0."""
    got = dcg(df, relevance, score, k, query).withColumnRenamed("dcg", "a")
    best = dcg(df, relevance, relevance, k, query).withColumnRenamed("dcg", "b")
    both = got.join(best, query) if query else got.crossJoin(best)
    return both.select(*(query or []), F.when(F.col("b") == 0, 0.0).otherwise(F.col("a") / F.col("b")).alias("ndcg"))
