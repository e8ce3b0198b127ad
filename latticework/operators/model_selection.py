"""Folds, cross-validation and grids. Fold numbers are a column; the folds of a grid run side by side."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import validation as V

#: Rows of a block of the two-level numbering.
BLOCK_ROWS = 100_000


def row_numbers(df: DataFrame, order: str, output: str = "lw_row") -> tuple[DataFrame, int]:
    """Rows numbered from 0 in the order of ``order`` (whole and unique numbers), and their count.

    In two levels: within blocks of a range of ``order`` side by side, and over the blocks' counts.
    """
    lo, hi, n = df.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    if not n:
        return df.withColumn(output, F.lit(0).cast("long")), 0
    width = max(1, -(-(hi - lo + 1) * BLOCK_ROWS // n))
    b = df.withColumn("lw_block", F.floor((F.col(order) - F.lit(lo)) / width))
    counts = b.groupBy("lw_block").count()
    base = counts.select("lw_block", F.coalesce(F.sum("count").over(W.orderBy("lw_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("lw_base"))
    own = F.row_number().over(W.partitionBy("lw_block").orderBy(order)) - 1
    return b.withColumn(output, own).join(base, "lw_block").withColumn(output, F.col(output) + F.col("lw_base")).drop("lw_block", "lw_base"), n


def with_folds(df: DataFrame, k: int, order: str, output: str = "fold") -> DataFrame:
    """Contiguous folds 0 .. k - 1 of n // k rows each; the rows left over are dropped."""
    V.positive_integer(k)
    rows, n = row_numbers(df, order)
    size = n // k
    if size == 0:
        raise ValueError(f"{n} rows don't make {k} folds")
    return rows.where(F.col("lw_row") < size * k).withColumn(output, F.floor(F.col("lw_row") / size).cast("int")).drop("lw_row")


class Folds(list):
    """(train, test) of each fold, over rows that are kept until ``release``."""

    def __init__(self, kept: DataFrame, k: int):
        self.kept = kept
        super().__init__((kept.where(F.col("lw_fold") != f).drop("lw_fold"), kept.where(F.col("lw_fold") == f).drop("lw_fold")) for f in range(k))

    def release(self) -> None:
        self.kept.unpersist()


def k_fold_split(df: DataFrame, k: int, order: str) -> Folds:
    """(train, test) of each fold."""
    return Folds(with_folds(df, k, order, "lw_fold").cache(), k)


def cross_validate(df: DataFrame, folding: Callable[[DataFrame], Iterator[tuple[DataFrame, DataFrame]]], scoring: Callable[[DataFrame, DataFrame], list[float]], parallel: int = 4) -> np.ndarray:
    """Scores, a row a metric, a column a fold."""
    folds = folding(df)
    try:
        with ThreadPoolExecutor(parallel) as pool:
            return np.array(list(pool.map(lambda s: scoring(*s), folds))).T
    finally:
        if isinstance(folds, Folds):
            folds.release()


def weighted_cross_validate(df: DataFrame, weight: str, folding: Callable, scoring: Callable[[DataFrame, DataFrame, str], list[float]], parallel: int = 4) -> np.ndarray:
    return cross_validate(df, folding, lambda train, test: scoring(train, test, weight), parallel)


def _grid(opts: dict[str, list]) -> list[dict]:
    return [dict(zip(opts, v)) for v in itertools.product(*opts.values())]


def grid_search(df: DataFrame, folding: Callable, scoring: Callable[[DataFrame, DataFrame, dict], list[float]], opts: dict[str, list]) -> list[tuple[dict, np.ndarray]]:
    """Every combination of options with its mean scores over the folds."""
    return [(o, cross_validate(df, folding, lambda a, b, o=o: scoring(a, b, o)).mean(1)) for o in _grid(opts)]


def weighted_grid_search(df: DataFrame, weights: list[str], folding: Callable, scoring: Callable[[DataFrame, DataFrame, str, dict], list[float]], opts: dict[str, list]) -> list[tuple[dict, np.ndarray]]:
    """As ``grid_search``, for each weight column too."""
    return [({**o, "weights": w}, cross_validate(df, folding, lambda a, b, o=o, w=w: scoring(a, b, w, o)).mean(1)) for w in weights for o in _grid(opts)]
