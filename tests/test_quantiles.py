"""Exact quantiles without a task that sees all values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import preprocessing, regression, stats


def test_quantiles_are_those_of_percentile(spark):
    rng = np.random.default_rng(4)
    kinds = {
        "wide": np.concatenate([rng.standard_normal(3000) * 10.0 ** rng.integers(-200, 200, 3000), [0.0, -0.0]]), "few": rng.integers(-3, 4, 3002) / 2,
        "close": 1e9 + rng.uniform(0, 1e-5, 3002), "one": np.full(3002, 7.5), "ends": np.concatenate([rng.uniform(size=3000), [np.inf, -np.inf]]),
    }
    df = spark.createDataFrame([tuple(None if i % 13 == 5 else float(v) for v in row) for i, row in enumerate(zip(*kinds.values()))], ", ".join(f"{c} double" for c in kinds))
    at = [0.0, 0.1, 0.25, 0.37, 0.5, 0.999, 1.0]
    want = df.select(*[F.percentile(c, F.array(*[F.lit(q) for q in at])).alias(c) for c in kinds]).first()
    got = stats.quantiles(df, {c: F.col(c) for c in kinds}, at)
    for c in kinds:
        assert got[c] == pytest.approx(list(want[c]), rel=1e-15)
    assert stats.quantiles(df.where("false"), {"wide": F.col("wide")}, [0.5]) == {"wide": [None]}


def test_no_percentile_over_a_whole_table(spark, monkeypatch):
    """``percentile`` brings all different values to one task."""

    def whole(*_):
        raise AssertionError("percentile")

    monkeypatch.setattr(F, "percentile", whole)
    df = spark.createDataFrame([(float(v), float(v % 7)) for v in range(101)], "y double, p double")
    assert regression.quantile(df, "y", 0.25) == 25.0
    assert preprocessing.RobustScaler.fit(df, ["y"]).shift == {"y": 50.0}
    assert preprocessing.SimpleImputer.fit(df, ["y"], "median").statistics == {"y": 50.0}
    assert regression.d2_absolute_error_score(df, "y", "p").first()[0] < 1
