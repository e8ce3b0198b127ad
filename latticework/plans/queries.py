"""Registered queries of the operators, each with SQL for an independent engine.

Numbers are rounded on both sides, and 0.0 is added after rounding so that no zero is negative.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as X
from ..operators import bayes, classification, clustering, decomposition, integrate, interpolation, linear, manifold, model_selection, neighbors, optimize, preprocessing, regression, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def rd(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded."""
    return df.select(*[rd(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def one(df: DataFrame, values: list[float], names: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(round(float(v), 6) + 0.0 for v in values)], ", ".join(f"{n} double" for n in names))


# Preprocessing.

NUM = ["l_quantity", "l_extendedprice", "l_discount"]
KEY = ["l_orderkey", "l_linenumber"]
SCALED = "SELECT l_orderkey, l_linenumber, {} FROM lineitem, ({}) s"


def _scaled(scaler, digits: int = 6, **opts):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(scaler.fit(lineitem(spark, d), NUM, **opts).transform(lineitem(spark, d)).select(*KEY, *NUM), digits)

    return run


query("standard_scaler", SCALED.format(", ".join(f"round(({c} - m{k}) / s{k}, 6) + 0.0 AS {c}" for k, c in enumerate(NUM)), "SELECT " + ", ".join(f"avg({c}) AS m{k}, stddev_pop({c}) AS s{k}" for k, c in enumerate(NUM)) + " FROM lineitem"))(_scaled(preprocessing.StandardScaler, per_column=True))
query("max_abs_scaler", SCALED.format(", ".join(f"round({c} / m{k}, 6) + 0.0 AS {c}" for k, c in enumerate(NUM)), "SELECT " + ", ".join(f"max(abs({c})) AS m{k}" for k, c in enumerate(NUM)) + " FROM lineitem"))(_scaled(preprocessing.MaxAbsScaler, per_column=True))
query("min_max_scaler", SCALED.format(", ".join(f"round(({c} - a{k}) / (b{k} - a{k}) * 2 - 1, 6) + 0.0 AS {c}" for k, c in enumerate(NUM)), "SELECT " + ", ".join(f"min({c}) AS a{k}, max({c}) AS b{k}" for k, c in enumerate(NUM)) + " FROM lineitem"))(_scaled(preprocessing.MinMaxScaler, per_column=True, min_bound=-1.0, max_bound=1.0))
query("robust_scaler", SCALED.format(", ".join(f"round(({c} - q{k}[2]) / (q{k}[3] - q{k}[1]), 6) + 0.0 AS {c}" for k, c in enumerate(NUM)), "SELECT " + ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q{k}" for k, c in enumerate(NUM)) + " FROM lineitem"))(_scaled(preprocessing.RobustScaler))
for _norm, _sql in {"euclidean": "sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice + l_discount * l_discount)", "manhattan": "abs(l_quantity) + abs(l_extendedprice) + abs(l_discount)", "chebyshev": "greatest(abs(l_quantity), abs(l_extendedprice), abs(l_discount))"}.items():
    query(f"normalizer_{_norm}", f"SELECT l_orderkey, l_linenumber, {', '.join(f'round({c} / n, 6) + 0.0 AS {c}' for c in NUM)} FROM (SELECT *, {_sql} AS n FROM lineitem)")(lambda spark, d, n=_norm: rounded(preprocessing.Normalizer.fit_transform(lineitem(spark, d), NUM, n).select(*KEY, *NUM)))


@query("binarizer", "SELECT l_orderkey, l_linenumber, (l_discount > 0.05)::INT AS l_discount FROM lineitem")
def _(spark, d):
    return preprocessing.Binarizer.fit_transform(lineitem(spark, d), ["l_discount"], 0.05).select(*KEY, "l_discount")


@query("ordinal_encoder", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::INT AS code FROM part")
def _(spark, d):
    return preprocessing.OrdinalEncoder.fit_transform(table(spark, d, "part"), "p_type", "code").select("p_partkey", "code")


@query("ordinal_encoder_unseen", "SELECT p_partkey, CASE WHEN r < 3 THEN r ELSE -1 END::INT AS code FROM (SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS r FROM part)")
def _(spark, d):
    part = table(spark, d, "part")
    return preprocessing.OrdinalEncoder.fit(part, "p_brand", 3).transform(part, "code").select("p_partkey", "code")


@query("ordinal_inverse", "SELECT p_partkey, p_type FROM part")
def _(spark, d):
    part = table(spark, d, "part")
    m = preprocessing.OrdinalEncoder.fit(part, "p_type")
    coded = m.transform(part.select("p_partkey", F.col("p_type").alias("t")).withColumnRenamed("t", "p_type"), "code").drop("p_type")
    back = preprocessing.OrdinalModel("code", m.categories, m.n).inverse_transform(coded, "p_type")
    return back.select("p_partkey", "p_type")


@query("one_hot_encoder", "WITH c AS (SELECT o_orderpriority AS p, (row_number() OVER (ORDER BY o_orderpriority) - 1) AS k FROM (SELECT DISTINCT o_orderpriority FROM orders)) SELECT o_orderkey, k AS position, (o_orderpriority = p)::INT AS hot FROM orders, c")
def _(spark, d):
    out = preprocessing.OneHotEncoder.fit_transform(table(spark, d, "orders"), "o_orderpriority", "hot")
    return out.select("o_orderkey", F.posexplode("hot").alias("position", "hot")).withColumn("position", F.col("position").cast("long"))


HOLES = "SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem"


def _holes(spark: SparkSession, d: str) -> DataFrame:
    return lineitem(spark, d).select(*KEY, F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 7 != 0, F.col("l_quantity")).alias("q"))


for _strategy, _sql in {"mean": "avg(q)", "median": "quantile_cont(q, 0.5)", "mode": "(SELECT q FROM h WHERE q IS NOT NULL GROUP BY q ORDER BY count(*) DESC, q LIMIT 1)", "constant": "-1"}.items():
    query(f"imputer_{_strategy}", f"WITH h AS ({HOLES}) SELECT l_orderkey, l_linenumber, round(coalesce(q, s), 6) + 0.0 AS q FROM h, (SELECT {_sql} AS s FROM {'h' if 'avg' in _sql or 'quantile' in _sql else '(SELECT 1)'}) t")(
        lambda spark, d, s=_strategy: rounded(preprocessing.SimpleImputer.fit(_holes(spark, d), ["q"], s, fill_value=-1.0).transform(_holes(spark, d)).select(*KEY, "q"))
    )

KNN_IMPUTE = """
WITH c AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal / 1000 END AS a, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey::DOUBLE END AS b, (s_suppkey % 11)::DOUBLE AS c FROM supplier),
p AS (SELECT q.id, x.id AS other, x.a AS xa, x.b AS xb,
  (q.a IS NOT NULL AND x.a IS NOT NULL)::INT + (q.b IS NOT NULL AND x.b IS NOT NULL)::INT + 1 AS n,
  coalesce((q.a - x.a) * (q.a - x.a), 0) + coalesce((q.b - x.b) * (q.b - x.b), 0) + (q.c - x.c) * (q.c - x.c) AS s FROM c q JOIN c x ON q.id <> x.id),
r AS (SELECT *, sqrt(s * 3 / n) AS d FROM p),
fa AS (SELECT id, avg(xa) AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM r WHERE xa IS NOT NULL) WHERE k <= 3 GROUP BY id),
fb AS (SELECT id, avg(xb) AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM r WHERE xb IS NOT NULL) WHERE k <= 3 GROUP BY id)
SELECT c.id, round(coalesce(c.a, fa.v), 6) + 0.0 AS a, round(coalesce(c.b, fb.v), 6) + 0.0 AS b FROM c LEFT JOIN fa USING (id) LEFT JOIN fb USING (id)
"""


@query("knn_imputer", KNN_IMPUTE)
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal") / 1000).alias("a"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey").cast("double")).alias("b"), (F.col("s_suppkey") % 11).cast("double").alias("c"))
    return rounded(neighbors.KNNImputer.fit_transform(s, "id", ["a", "b", "c"], 3).select("id", "a", "b"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "events")
    return o.groupBy("user_id").agg(F.collect_list(F.length("event_type")).alias("tokens"))


@query("count_vectorizer", "SELECT user_id, length(event_type) AS token, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return preprocessing.CountVectorizer.long(_tokens(spark, d), "user_id", "tokens").withColumn("token", F.col("token").cast("long"))


@query("count_vectorizer_max", "SELECT max(length(event_type)) AS max_token FROM events")
def _(spark, d):
    return _tokens(spark, d).agg(F.max(F.array_max("tokens")).cast("long").alias("max_token"))


@query("count_vectorizer_dense", "WITH t AS (SELECT user_id, length(event_type) AS token FROM events), m AS (SELECT max(token) AS m FROM t), c AS (SELECT user_id, k FROM (SELECT DISTINCT user_id FROM t), m, generate_series(0, m) AS g(k)) SELECT c.user_id, c.k AS token, count(t.token) AS n FROM c LEFT JOIN t ON t.user_id = c.user_id AND t.token = c.k GROUP BY ALL")
def _(spark, d):
    out = preprocessing.CountVectorizer.fit_transform(_tokens(spark, d), "tokens", "row")
    return out.select("user_id", F.posexplode("row").alias("token", "n")).select("user_id", F.col("token").cast("long"), F.col("n").cast("long"))


# Statistics.


def _scalar(fn, name: str):
    return lambda spark, d: rounded(fn(lineitem(spark, d)).select(*[F.col(c).alias(f"{name}_{c}") for c in NUM]))


def _moments(expr: str, name: str) -> str:
    parts = ", ".join(f"round({expr.format(m2=f'avg(({c} - m{k}) ** 2)', m3=f'avg(({c} - m{k}) ** 3)', m4=f'avg(({c} - m{k}) ** 4)', n='count(*)')}, 6) + 0.0 AS {name}_{c}" for k, c in enumerate(NUM))
    return f"SELECT {parts} FROM lineitem, (SELECT {', '.join(f'avg({c}) AS m{k}' for k, c in enumerate(NUM))} FROM lineitem) s"


query("moment", "SELECT " + ", ".join(f"round(avg((({c} - m{k}) / 1000) ** 3), 6) + 0.0 AS m_{c}" for k, c in enumerate(NUM)) + " FROM lineitem, (SELECT " + ", ".join(f"avg({c}) AS m{k}" for k, c in enumerate(NUM)) + " FROM lineitem) s")(
    lambda spark, d: rounded(stats.moment(lineitem(spark, d).select(*[(F.col(c) / 1000).alias(c) for c in NUM]), NUM, 3).select(*[F.col(c).alias(f"m_{c}") for c in NUM]))
)
query("skew", _moments("{m3} / ({m2} ** 1.5)", "skew"))(_scalar(lambda t: stats.skew(t, NUM), "skew"))
query("skew_unbiased", _moments("{m3} / ({m2} ** 1.5) * sqrt({n} * ({n} - 1.0)) / ({n} - 2)", "skew"))(_scalar(lambda t: stats.skew(t, NUM, False), "skew"))
query("kurtosis", _moments("{m4} / ({m2} ** 2) - 3", "kurt"))(_scalar(lambda t: stats.kurtosis(t, NUM), "kurt"))
query("kurtosis_unbiased_pearson", _moments("(({n} + 1) * ({m4} / ({m2} ** 2) - 3) + 6) * ({n} - 1.0) / (({n} - 2) * ({n} - 3)) + 3", "kurt"))(_scalar(lambda t: stats.kurtosis(t, NUM, False, "pearson"), "kurt"))


@query("correlation_matrix", " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {'1.0' if i == j else f'round(corr({a}, {b}), 6) + 0.0'} AS v FROM lineitem" for i, a in enumerate(NUM) for j, b in enumerate(NUM) if i != j) + " UNION ALL SELECT i, i, 1.0 FROM generate_series(0, 2) AS g(i)")
def _(spark, d):
    return rounded(stats.correlation_matrix(lineitem(spark, d), NUM))


def _cov_sql(inner: str, a: str = "covar_pop") -> str:
    return " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round({inner.format(c=f'{a}({x}, {y})', eye=int(i == j))}, 4) + 0.0 AS v FROM lineitem" for i, x in enumerate(NUM) for j, y in enumerate(NUM))


@query("empirical_covariance", _cov_sql("{c}"))
def _(spark, d):
    t = lineitem(spark, d)
    return rounded(stats._matrix_frame(t, NUM, stats.empirical_covariance(t, NUM)), 4)


_MU = "(" + " + ".join(f"var_pop({c})" for c in NUM) + ") / 3"


@query("shrunk_covariance", _cov_sql("0.8 * {c} + 0.2 * {eye} * " + _MU))
def _(spark, d):
    t = lineitem(spark, d)
    return rounded(stats._matrix_frame(t, NUM, stats.ShrunkCovariance.fit(t, NUM, 0.2).covariance), 4)


_N2 = " + ".join(f"({c} - m{k}) ** 2" for k, c in enumerate(NUM))
LEDOIT = f"""
WITH s AS (SELECT {', '.join(f'avg({c}) AS m{k}' for k, c in enumerate(NUM))} FROM lineitem),
f AS (SELECT avg(({_N2}) ** 2) AS f, count(*) AS n FROM lineitem, s),
c AS (SELECT {' + '.join(f'covar_pop({a}, {b}) ** 2' for a in NUM for b in NUM)} AS q, {' + '.join(f'var_pop({c})' for c in NUM)} AS t FROM lineitem)
SELECT round(least((f - q) / n / 3, (q - t * t / 3) / 3) / ((q - t * t / 3) / 3), 8) + 0.0 AS shrinkage FROM f, c
"""


@query("ledoit_wolf", LEDOIT)
def _(spark, d):
    t = lineitem(spark, d)
    return t.sparkSession.createDataFrame([(float(stats.LedoitWolf.fit(t, NUM).shrinkage),)], "shrinkage double").select(rd("shrinkage", 8).alias("shrinkage"))


@query("center", "SELECT l_orderkey, l_linenumber, round(l_discount - m, 6) + 0.0 AS l_discount FROM lineitem, (SELECT avg(l_discount) AS m FROM lineitem)")
def _(spark, d):
    return rounded(stats.center(lineitem(spark, d), ["l_discount"]).select(*KEY, "l_discount"))


# Classification.

O_SQL = """WITH o AS (SELECT o_orderkey AS id, (o_orderpriority < '3')::INT AS y, (o_totalprice > 180000)::INT AS p, round(o_totalprice / 1000) / 1000 AS s,
 CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS t, (o_custkey % 3)::INT AS q, 1.0 + o_orderkey % 3 AS w FROM orders) """


def pairs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderpriority") < "3").cast("int").alias("y"), (F.col("o_totalprice") > 180000).cast("int").alias("p"), (F.round(F.col("o_totalprice") / 1000) / 1000).alias("s"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("t"), (F.col("o_custkey") % 3).cast("int").alias("q"), (1.0 + F.col("o_orderkey") % 3).alias("w"),
    )


def metric(name: str, sql: str, fn, digits: int = 6):
    query(name, O_SQL + sql)(lambda spark, d: rounded(fn(pairs(spark, d)), digits))


C = classification
metric("accuracy", "SELECT round(avg((t = q)::INT), 6) + 0.0 AS accuracy FROM o", lambda o: C.accuracy(o, "t", "q"))
metric("zero_one_loss", "SELECT round(sum((t <> q)::INT), 6) + 0.0 AS loss FROM o", lambda o: C.zero_one_loss(o, "t", "q", False))
metric("binary_precision", "SELECT round(sum((y = 1 AND p = 1)::INT) / sum(p), 6) + 0.0 AS precision FROM o", lambda o: C.binary_precision(o, "y", "p"))
metric("binary_recall", "SELECT round(sum((y = 1 AND p = 1)::INT) / sum(y), 6) + 0.0 AS recall FROM o", lambda o: C.binary_recall(o, "y", "p"))
metric("binary_sensitivity", "SELECT round(sum((y = 1 AND p = 1)::INT) / sum(y), 6) + 0.0 AS recall FROM o", lambda o: C.binary_sensitivity(o, "y", "p"))
metric("binary_specificity", "SELECT round(sum((y = 0 AND p = 0)::INT) / sum(1 - y), 6) + 0.0 AS specificity FROM o", lambda o: C.binary_specificity(o, "y", "p"))
metric("mcc", "SELECT round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) + 0.0 AS mcc FROM (SELECT sum((y = 1 AND p = 1)::INT)::DOUBLE AS tp, sum((y = 0 AND p = 0)::INT)::DOUBLE AS tn, sum((y = 0 AND p = 1)::INT)::DOUBLE AS fp, sum((y = 1 AND p = 0)::INT)::DOUBLE AS fn FROM o)", lambda o: C.mcc(o, "y", "p"))
CLASSES = ", c AS (SELECT k AS label, sum((t = k AND q = k)::INT) AS tp, sum((t <> k AND q = k)::INT) AS fp, sum((t = k AND q <> k)::INT) AS fn, sum((t <> k AND q <> k)::INT) AS tn FROM o, (SELECT k::INT AS k FROM generate_series(0, 2) AS g(k)) GROUP BY k) "
metric("precision", CLASSES + "SELECT label, round(tp / (tp + fp), 6) + 0.0 AS precision FROM c", lambda o: C.precision(o, "t", "q", 3))
metric("recall", CLASSES + "SELECT label, round(tp / (tp + fn), 6) + 0.0 AS recall FROM c", lambda o: C.recall(o, "t", "q", 3))
metric("sensitivity", CLASSES + "SELECT label, round(tp / (tp + fn), 6) + 0.0 AS recall FROM c", lambda o: C.sensitivity(o, "t", "q", 3))
metric("specificity", CLASSES + "SELECT label, round(tn / (tn + fp), 6) + 0.0 AS specificity FROM c", lambda o: C.specificity(o, "t", "q", 3))
CELLS = "(SELECT a.k::INT AS t, b.k::INT AS q FROM generate_series(0, 2) AS a(k), generate_series(0, 2) AS b(k)) g"
metric("confusion_matrix", f"SELECT g.t, g.q, count(o.id)::DOUBLE AS n FROM {CELLS} LEFT JOIN o ON o.t = g.t AND o.q = g.q GROUP BY ALL", lambda o: C.confusion_matrix(o, "t", "q", 3))
metric("confusion_matrix_weighted", f"SELECT t, q, round(n / sum(n) OVER (PARTITION BY t), 6) + 0.0 AS n FROM (SELECT g.t, g.q, coalesce(sum(w), 0.0) AS n FROM {CELLS} LEFT JOIN o ON o.t = g.t AND o.q = g.q GROUP BY ALL)", lambda o: C.confusion_matrix(o, "t", "q", 3, "w", True))
metric("balanced_accuracy", CLASSES + "SELECT round((avg(tp / (tp + fn)) - 1 / 3.0) / (1 - 1 / 3.0), 6) + 0.0 AS balanced_accuracy FROM c", lambda o: C.balanced_accuracy_score(o, "t", "q", 3, True))
_F = "CASE WHEN tp = 0 THEN 0 ELSE {b} * tp / ({b} * tp + {b1} * fn + fp) END"
metric("fbeta_score", CLASSES + f"SELECT label, round({_F.format(b=5.0, b1=4.0)}, 6) + 0.0 AS fscore FROM c", lambda o: C.fbeta_score(o, "t", "q", 2.0, 3))
metric("f1_macro", CLASSES + f"SELECT round(avg({_F.format(b=2.0, b1=1.0)}), 6) + 0.0 AS fscore FROM c", lambda o: C.f1_score(o, "t", "q", 3, "macro"))
metric("f1_weighted", CLASSES + f"SELECT round(sum({_F.format(b=2.0, b1=1.0)} * (tp + fn)) / sum(tp + fn), 6) + 0.0 AS fscore FROM c", lambda o: C.f1_score(o, "t", "q", 3, "weighted"))
metric("precision_recall_fscore_support", CLASSES + f"SELECT label, round(tp / (tp + fp), 6) + 0.0 AS precision, round(tp / (tp + fn), 6) + 0.0 AS recall, round({_F.format(b=2.0, b1=1.0)}, 6) + 0.0 AS fscore, (tp + fn)::DOUBLE AS support FROM c", lambda o: C.precision_recall_fscore_support(o, "t", "q", 3))
metric("precision_recall_fscore_micro", CLASSES + "SELECT round(sum(tp) / sum(tp + fp), 6) + 0.0 AS precision, round(sum(tp) / sum(tp + fn), 6) + 0.0 AS recall, sum(tp + fn)::DOUBLE AS support, round(sum(tp) / sum(tp + fn), 6) + 0.0 AS fscore FROM c", lambda o: C.precision_recall_fscore_support(o, "t", "q", 3, average="micro"))
KAPPA = ", m AS (SELECT t, q, count(*)::DOUBLE AS n FROM o GROUP BY ALL), r AS (SELECT t, sum(n) AS a FROM m GROUP BY t), k AS (SELECT q, sum(n) AS b FROM m GROUP BY q) SELECT round(1 - (SELECT sum({c} * n) FROM m) / (SELECT sum({c} * a * b) / (SELECT sum(n) FROM m) FROM r, k), 6) + 0.0 AS kappa"
metric("cohen_kappa", KAPPA.format(c="(t <> q)::INT"), lambda o: C.cohen_kappa_score(o, "t", "q", 3))
metric("cohen_kappa_quadratic", KAPPA.format(c="(t - q) * (t - q)"), lambda o: C.cohen_kappa_score(o, "t", "q", 3, weighting="quadratic"))
metric("brier_score", "SELECT round(sum(w * (y - least(1, greatest(0, s))) ** 2) / sum(w), 6) + 0.0 AS brier FROM o", lambda o: C.brier_score_loss(o, "y", "s", weight="w"))
PROBA = "list_value((1 + s) / (3 + s), 1 / (3 + s), 1 / (3 + s))"


def _with_proba(o: DataFrame) -> DataFrame:
    s = F.col("s")
    return o.withColumn("pr", F.array((1 + s) / (3 + s), 1 / (3 + s), 1 / (3 + s)))


metric("log_loss", f"SELECT round(avg(-ln({PROBA}[t + 1])), 6) + 0.0 AS log_loss FROM o", lambda o: C.log_loss(_with_proba(o), "t", "pr"))
metric("top_k_accuracy", "SELECT round(avg((t <= 1)::INT), 6) + 0.0 AS top_k_accuracy FROM o", lambda o: C.top_k_accuracy_score(_with_proba(o), "t", "pr", 2))
CURVE = ", g AS (SELECT s, sum(w * y) AS p, sum(w * (1 - y)) AS n FROM o GROUP BY s), v AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tps, sum(n) OVER (ORDER BY s DESC) AS fps, p, n FROM g), e AS (SELECT sum(p) AS pp, sum(n) AS nn, max(s) AS top FROM g) "
metric("roc_curve", CURVE + "SELECT round(fps / nn, 6) + 0.0 AS fpr, round(tps / pp, 6) + 0.0 AS tpr, round(s, 6) + 0.0 AS threshold FROM v, e UNION ALL SELECT 0.0, 0.0, round(top + 1, 6) + 0.0 FROM e", lambda o: C.roc_curve(o, "y", "s", "w"))
metric("precision_recall_curve", CURVE + "SELECT round(tps / (tps + fps), 6) + 0.0 AS precision, round(tps / pp, 6) + 0.0 AS recall, round(s, 6) + 0.0 AS threshold FROM v, e UNION ALL SELECT 1.0, 0.0, NULL", lambda o: C.precision_recall_curve(o, "y", "s", "w"))
metric("det_curve", CURVE + "SELECT round(fps / nn, 6) + 0.0 AS fpr, round(1 - tps / pp, 6) + 0.0 AS fnr, round(s, 6) + 0.0 AS threshold FROM v, e", lambda o: C.det_curve(o, "y", "s", "w"))
metric("roc_auc", CURVE + "SELECT round(sum(n * (tps - p / 2)) / max(pp * nn), 6) + 0.0 AS auc FROM v, e", lambda o: C.roc_auc_score(o, "y", "s", "w"))
metric("average_precision", CURVE + "SELECT round(sum(p * tps / (tps + fps)) / max(pp), 6) + 0.0 AS average_precision FROM v, e", lambda o: C.average_precision_score(o, "y", "s", "w"))
metric("distinct_values", "SELECT DISTINCT round(s, 6) + 0.0 AS threshold FROM o", lambda o: C.distinct_values(o, "s"))
metric("auc", "SELECT round(sum(a), 6) + 0.0 AS auc FROM (SELECT (s - lag(s) OVER (ORDER BY s)) * (v + lag(v) OVER (ORDER BY s)) / 2 AS a FROM (SELECT s, avg(y) AS v FROM o GROUP BY s))", lambda o: C.auc(o.groupBy("s").agg(F.avg("y").alias("v")), "s", "v"))

# Regression and ranking.

R_SQL = "WITH r AS (SELECT l_extendedprice / 1000 AS y, l_quantity * 1.5 + 1 AS p, 1.0 + l_linenumber AS w, l_orderkey AS k, l_linenumber AS i FROM lineitem) "


def targets(spark: SparkSession, d: str) -> DataFrame:
    return lineitem(spark, d).select((F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5 + 1).alias("p"), (1.0 + F.col("l_linenumber")).alias("w"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"))


R = regression
PIN = "CASE WHEN y >= {q} THEN {a} * (y - {q}) ELSE ({a} - 1) * (y - {q}) END"
for _name, _sql, _fn in [
    ("mean_absolute_error", "SELECT avg(abs(y - p)) AS mae FROM r", lambda t: R.mean_absolute_error(t, "y", "p")),
    ("mean_square_error", "SELECT avg((y - p) ** 2) AS mse FROM r", lambda t: R.mean_square_error(t, "y", "p")),
    ("mean_square_log_error", "SELECT avg((ln(1 + y) - ln(1 + p)) ** 2) AS msle FROM r", lambda t: R.mean_square_log_error(t, "y", "p")),
    ("mean_absolute_percentage_error", "SELECT avg(abs(y - p) / greatest(2.220446049250313e-16, abs(y))) AS mape FROM r", lambda t: R.mean_absolute_percentage_error(t, "y", "p")),
    ("max_residual_error", "SELECT max(abs(y - p)) AS max_error FROM r", lambda t: R.max_residual_error(t, "y", "p")),
    ("mean_poisson_deviance", "SELECT avg(2 * (y * ln(y / p) - y + p)) AS deviance FROM r", lambda t: R.mean_poisson_deviance(t, "y", "p")),
    ("mean_gamma_deviance", "SELECT avg(2 * (ln(p / y) + y / p - 1)) AS deviance FROM r", lambda t: R.mean_gamma_deviance(t, "y", "p")),
    ("mean_tweedie_deviance", "SELECT avg(2 * (y ** 0.5 / (-0.5 * 0.5) - y * p ** -0.5 / -0.5 + p ** 0.5 / 0.5)) AS deviance FROM r", lambda t: R.mean_tweedie_deviance(t, "y", "p", 1.5)),
    ("mean_tweedie_deviance_checked", "SELECT avg(2 * (y ** 0.5 / (-0.5 * 0.5) - y * p ** -0.5 / -0.5 + p ** 0.5 / 0.5)) AS deviance FROM r", lambda t: R.mean_tweedie_deviance_checked(t, "y", "p", 1.5)),
    ("r2_score", "SELECT 1 - sum((y - p) ** 2) / sum((y - m) ** 2) AS r2 FROM r, (SELECT avg(y) AS m FROM r)", lambda t: R.r2_score(t, "y", "p")),
    ("explained_variance", "SELECT 1 - var_pop(y - p) / var_pop(y) AS explained_variance FROM r", lambda t: R.explained_variance_score(t, "y", "p")),
    ("d2_tweedie", "SELECT 1 - avg(2 * (ln(p / y) + y / p - 1)) / avg(2 * (ln(m / y) + y / m - 1)) AS d2 FROM r, (SELECT avg(y) AS m FROM r)", lambda t: R.d2_tweedie_score(t, "y", "p", 2)),
    ("mean_pinball_loss", f"SELECT sum(w * {PIN.format(q='p', a=0.3)}) / sum(w) AS pinball FROM r", lambda t: R.mean_pinball_loss(t, "y", "p", 0.3, "w")),
    ("d2_pinball", f"SELECT 1 - avg({PIN.format(q='p', a=0.3)}) / avg({PIN.format(q='m', a=0.3)}) AS d2 FROM r, (SELECT quantile_cont(y, 0.3) AS m FROM r)", lambda t: R.d2_pinball_score(t, "y", "p", 0.3)),
    ("d2_absolute_error", "SELECT 1 - avg(abs(y - p)) / avg(abs(y - m)) AS d2 FROM r, (SELECT quantile_cont(y, 0.5) AS m FROM r)", lambda t: R.d2_absolute_error_score(t, "y", "p")),
    ("quantile", "SELECT quantile_cont(y, 0.37) AS q FROM r", lambda t: t.sparkSession.createDataFrame([(R.quantile(t, "y", 0.37),)], "q double")),
]:
    _head, _, _tail = _sql.partition(" AS ")
    _col, _, _from = _tail.partition(" FROM ")
    query(_name, R_SQL + f"SELECT round(x, 6) + 0.0 AS {_col} FROM ({_head} AS x FROM {_from})" if " AS " not in _head else R_SQL + _sql)(lambda spark, d, f=_fn: rounded(f(targets(spark, d))))


@query("dcg", R_SQL + "SELECT k, round(sum(y / log2(n + 1)), 6) + 0.0 AS dcg FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC, y DESC) AS n FROM r) WHERE n <= 3 GROUP BY k")
def _(spark, d):
    return rounded(R.dcg(targets(spark, d), "y", "p", 3, ["k"]))


@query("ndcg", R_SQL + "SELECT k, round(sum(y / log2(n + 1)) / sum(y / log2(m + 1)), 6) + 0.0 AS ndcg FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC, y DESC) AS n, row_number() OVER (PARTITION BY k ORDER BY y DESC) AS m FROM r) GROUP BY k")
def _(spark, d):
    return rounded(R.ndcg(targets(spark, d), "y", "p", None, ["k"]))


# Distances.

E_SQL = "WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings) "
PAIRED = E_SQL + ", p AS (SELECT a.id, a.v AS x, b.v AS y FROM e a JOIN e b ON b.id = a.id + 1) "


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), X.doubles("embedding").alias("features"), "label")


def neighbours_of_next(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    return e.select("id", F.col("features").alias("x")).join(e.select((F.col("id") - 1).alias("id"), F.col("features").alias("y")), "id")


for _name, _sql, _fn in [
    ("euclidean", "list_distance(x, y)", X.euclidean),
    ("squared_euclidean", "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) ** 2))", X.squared_euclidean),
    ("manhattan", "list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2])))", X.manhattan),
    ("chebyshev", "list_max(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2])))", X.chebyshev),
    ("minkowski", "list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]) ** 3)) ** (1 / 3.0)", lambda a, b: X.minkowski(a, b, 3)),
    ("cosine", "greatest(0, 1 - list_cosine_similarity(x, y))", X.cosine),
    ("hamming", "list_avg(list_transform(list_zip(x, y), lambda z: (round(z[1] * 4) <> round(z[2] * 4))::INT))", lambda a, b: X.hamming(F.transform(a, lambda v: F.round(v * 4)), F.transform(b, lambda v: F.round(v * 4)))),
    ("jaccard", "len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))", X.jaccard),
    ("dice_coefficient", "2 * len(list_intersect(a, b)) / (len(list_intersect(a, b)) + len(list_distinct(list_concat(a, b))))", X.dice_coefficient),
    ("binary_jaccard", "list_sum(list_transform(list_zip(a, b), lambda z: (z[1] <> 0 AND z[2] <> 0)::INT)) / list_sum(list_transform(list_zip(a, b), lambda z: (z[1] <> 0 OR z[2] <> 0)::INT))", X.binary_jaccard),
    ("dice_coefficient_binary", "2 * list_sum(list_transform(list_zip(a, b), lambda z: (z[1] <> 0 AND z[2] <> 0)::INT)) / (list_sum(list_transform(list_zip(a, b), lambda z: (z[1] <> 0)::INT)) + list_sum(list_transform(list_zip(a, b), lambda z: (z[2] <> 0)::INT)))", X.dice_coefficient_binary),
]:
    _sets = "(a, b)" in _sql
    _from = "(SELECT id, list_transform(x, lambda v: floor(v * 8)::INT) AS a, list_transform(y, lambda v: floor(v * 8)::INT) AS b FROM p)" if _sets else "p"
    query(f"distance_{_name}", PAIRED + f"SELECT id, round({_sql}, 6) + 0.0 AS d FROM {_from}")(
        lambda spark, d, f=_fn, s=_sets: neighbours_of_next(spark, d).select("id", rd(f(*[F.transform(c, lambda v: F.floor(v * 8).cast("int")) if s else F.col(c) for c in ("x", "y")])).alias("d"))
    )


@query("pairwise_euclidean", E_SQL + "SELECT a.id AS query_id, b.id AS neighbor_id, round(list_distance(a.v, b.v), 5) + 0.0 AS distance FROM e a, e b")
def _(spark, d):
    e = embeddings(spark, d)
    return neighbors.pairwise(e, e, digits=5)


SUPPLIERS = "WITH s AS (SELECT s_suppkey AS id, [s_acctbal / 1000, s_nationkey::DOUBLE, (s_suppkey % 7)::DOUBLE] AS v FROM supplier) "


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 7).cast("double")).alias("features"))


for _metric, _sql in {"squared_euclidean": "list_distance(a.v, b.v) ** 2", "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))", "cosine": "greatest(0, 1 - list_cosine_similarity(a.v, b.v))"}.items():
    query(f"pairwise_{_metric}", SUPPLIERS + f"SELECT a.id AS query_id, b.id AS neighbor_id, round({_sql}, 6) + 0.0 AS distance FROM s a, s b")(lambda spark, d, m=_metric: neighbors.pairwise(suppliers(spark, d), suppliers(spark, d), m, digits=6))


@query("hamming_weighted", "SELECT id, round(list_sum(list_transform(list_zip(v, w, u), lambda z: z[3] * (z[1] <> z[2])::INT)) / list_sum(u), 6) + 0.0 AS d FROM (SELECT s_suppkey AS id, [s_suppkey % 2, s_suppkey % 3, s_nationkey] AS v, [s_suppkey % 3, s_suppkey % 5, s_nationkey] AS w, [1.0, 2.0, s_nationkey + 1.0] AS u FROM supplier)")
def _(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("long")
    s = table(spark, d, "supplier").select(k.alias("id"), F.array(k % 2, k % 3, n).alias("v"), F.array(k % 3, k % 5, n).alias("w"), F.array(F.lit(1.0), F.lit(2.0), n + 1.0).alias("u"))
    return s.select("id", rd(X.hamming("v", "w", "u")).alias("d"))


# Neighbours.

KNN = E_SQL + ", k AS (SELECT * FROM (SELECT a.id AS query_id, b.id AS neighbor_id, b.label, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) - 1 AS rank FROM e a JOIN e b ON a.id <> b.id AND a.id % 100 = 0) WHERE rank < 5) "


def asked(e: DataFrame) -> DataFrame:
    """Queries of the searches: every row whose id is divisible by 100, each against all rows."""
    return e.where("id % 100 = 0")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    model = neighbors.KNNClassifier.fit(e, "label", 10, 5, exclude_self=True)
    return model.predict(asked(e)).join(e.select(F.col("id").alias("query_id"), F.col("label").alias("truth")), "query_id")


@query("knn_search", KNN + "SELECT query_id, rank, neighbor_id, round(distance, 5) + 0.0 AS distance FROM k")
def _(spark, d):
    e = embeddings(spark, d)
    return rounded(neighbors.BruteKNN.fit(e, 5, exclude_self=True).predict(asked(e)), 5).withColumn("rank", F.col("rank").cast("long"))


@query("knn_classifier", KNN + "SELECT query_id, p.label, e.label AS truth FROM (SELECT query_id, label FROM (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, label) AS n FROM k GROUP BY query_id, label) WHERE n = 1) p JOIN e ON e.id = query_id")
def _(spark, d):
    return flagship(spark, d)


@query("knn_classifier_probability", KNN + "SELECT query_id, label, round(count(*) / 5, 6) + 0.0 AS probability FROM k GROUP BY query_id, label")
def _(spark, d):
    e = embeddings(spark, d)
    return rounded(neighbors.KNNClassifier.fit(e, "label", 10, 5, exclude_self=True).predict_probability(asked(e)))


@query("knn_regressor", KNN + "SELECT query_id, round(sum(label / distance) / sum(1 / distance), 4) + 0.0 AS prediction FROM k GROUP BY query_id")
def _(spark, d):
    e = embeddings(spark, d)
    return rounded(neighbors.KNNRegressor.fit(e, "label", 5, "distance", exclude_self=True).predict(asked(e)), 4)


@query("kd_tree", E_SQL + "SELECT * FROM (SELECT a.id AS query_id, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) - 1 AS rank, b.id AS neighbor_id, round(list_distance(a.v, b.v), 5) + 0.0 AS distance FROM e a, e b WHERE a.id % 100 = 0) WHERE rank < 3")
def _(spark, d):
    e = embeddings(spark, d)
    return rounded(neighbors.KDTree.fit(e, num_neighbors=3).predict(asked(e)), 5).withColumn("rank", F.col("rank").cast("long"))


RADIUS = E_SQL + ", r AS (SELECT a.id AS query_id, b.label FROM e a JOIN e b ON a.id <> b.id AND a.id % 100 = 0 AND list_distance(a.v, b.v) <= 0.9) "


@query("radius_classifier", RADIUS + "SELECT e.id AS query_id, coalesce(p.label, -1) AS label FROM e LEFT JOIN (SELECT query_id, label FROM (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, label) AS n FROM r GROUP BY query_id, label) WHERE n = 1) p ON p.query_id = e.id WHERE e.id % 100 = 0")
def _(spark, d):
    e = embeddings(spark, d)
    return neighbors.RadiusNNClassifier.fit(e, "label", 10, radius=0.9, exclude_self=True).predict(asked(e))


@query("radius_regressor", RADIUS + "SELECT e.id AS query_id, coalesce(round(avg(r.label), 6) + 0.0, -1.0) AS prediction FROM e LEFT JOIN r ON r.query_id = e.id WHERE e.id % 100 = 0 GROUP BY e.id")
def _(spark, d):
    e = embeddings(spark, d)
    out = neighbors.RadiusNNRegressor.fit(e, "label", radius=0.9, exclude_self=True).predict(asked(e))
    return rounded(out.withColumn("prediction", F.when(F.isnan("prediction"), -1.0).otherwise(F.col("prediction"))))


@query("neighbors_recall", E_SQL + "SELECT 1.0 AS recall")
def _(spark, d):
    e = embeddings(spark, d)
    k = neighbors.BruteKNN.fit(e, 5).predict(asked(e))
    return neighbors.neighbors_recall(k, k)


def single(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as they are stored, in single precision; operators make doubles of them where they calculate."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


@query("random_projection_forest")
def _(spark, d):
    e = single(spark, d)
    return neighbors.RandomProjectionForest.fit(e, 5, recall=0.9).predict(e)


@query("large_vis")
def _(spark, d):
    return neighbors.LargeVis.fit(single(spark, d), 5, recall=0.9)


@query("nn_descent")
def _(spark, d):
    return neighbors.NNDescent.fit(single(spark, d), 5, recall=0.9).graph


# Linear models.


@query("linear_regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) + 0.0 AS intercept FROM lineitem")
def _(spark, d):
    m = linear.LinearRegression.fit(lineitem(spark, d), ["l_quantity"], "l_extendedprice")
    return rounded(spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double"), 4)


TWO = """
WITH r AS (SELECT l_quantity AS a, l_discount * 100 AS b, l_extendedprice / 1000 AS y FROM lineitem),
c AS (SELECT var_pop(a) * count(*) + {alpha} AS aa, var_pop(b) * count(*) + {alpha} AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM r),
w AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS u, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS v, ma, mb, my FROM c)
SELECT round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v, round(my - u * ma - v * mb, 5) + 0.0 AS intercept FROM w
"""


def _two(spark: SparkSession, d: str) -> DataFrame:
    return lineitem(spark, d).select(*KEY, F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"), (F.col("l_extendedprice") / 1000).alias("y"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("c"))


def _coef(spark: SparkSession, m) -> DataFrame:
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.coefficients[1]), float(m.intercept))], "u double, v double, intercept double").select(rd("u").alias("u"), rd("v").alias("v"), rd("intercept", 5).alias("intercept"))


query("linear_regression_two", TWO.format(alpha=0))(lambda spark, d: _coef(spark, linear.LinearRegression.fit(_two(spark, d), ["a", "b"], "y")))
query("ridge_regression", TWO.format(alpha=1000))(lambda spark, d: _coef(spark, linear.RidgeRegression.fit(_two(spark, d), ["a", "b"], "y", 1000.0)))
query("ridge_regression_cholesky", TWO.format(alpha=1000))(lambda spark, d: _coef(spark, linear.RidgeRegression.fit(_two(spark, d), ["a", "b"], "y", 1000.0, solver="cholesky")))


@query("linear_regression_predict", "SELECT l_orderkey, l_linenumber, round(regr_intercept(l_extendedprice, l_quantity) OVER () + regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity, 3) + 0.0 AS prediction FROM lineitem")
def _(spark, d):
    t = lineitem(spark, d)
    return rounded(linear.LinearRegression.fit(t, ["l_quantity"], "l_extendedprice").predict(t).select(*KEY, "prediction"), 3)


@query("polynomial_features", "SELECT l_orderkey, l_linenumber, 1.0 AS poly0, a AS poly1, b AS poly2, round(a * a, 6) + 0.0 AS poly3, round(a * b, 6) + 0.0 AS poly4, round(b * b, 6) + 0.0 AS poly5 FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a, round(l_tax * 100) + 0.0 AS b FROM lineitem)")
def _(spark, d):
    t = lineitem(spark, d).select(*KEY, F.col("l_quantity").alias("a"), (F.round(F.col("l_tax") * 100) + 0.0).alias("b"))
    return rounded(linear.PolynomialRegression.transform(t, ["a", "b"], 2).drop("a", "b"))


@query("polynomial_regression", "WITH r AS (SELECT l_quantity / 10 AS x, (l_quantity / 10) ** 2 AS z, l_extendedprice / 1000 AS y FROM lineitem), c AS (SELECT var_pop(x) AS aa, var_pop(z) AS bb, covar_pop(x, z) AS ab, covar_pop(x, y) AS ay, covar_pop(z, y) AS by_, avg(x) AS ma, avg(z) AS mb, avg(y) AS my FROM r), w AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS u, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS v, * FROM c) SELECT round(u, 4) + 0.0 AS u, round(v, 4) + 0.0 AS v, round(my - u * ma - v * mb, 4) + 0.0 AS intercept FROM w")
def _(spark, d):
    t = lineitem(spark, d).select((F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    m = linear.PolynomialRegression.fit(t, ["x"], "y", 2).linear
    return rounded(spark.createDataFrame([(float(m.coefficients[0]), float(m.coefficients[1]), float(m.intercept))], "u double, v double, intercept double"), 4)


@query("bayesian_ridge")
def _(spark, d):
    m = linear.BayesianRidgeRegression.fit(_two(spark, d), ["a", "b"], "y")
    return one(_two(spark, d), [*m.coefficients, m.intercept, m.alpha, m.lambda_], ["u", "v", "intercept", "alpha", "lambda"])


ISOTONIC = """
WITH g AS (SELECT p_size::DOUBLE AS x, avg(p_retailprice) AS y, count(*) AS w FROM part GROUP BY 1),
c AS (SELECT *, sum(w * y) OVER (ORDER BY x) AS s, sum(w) OVER (ORDER BY x) AS n, coalesce(sum(w * y) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, coalesce(sum(w) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n0 FROM g),
m AS (SELECT a.x AS x, k.x AS lo, min((b.s - k.s0) / (b.n - k.n0)) AS v FROM c a JOIN c k ON k.x <= a.x JOIN c b ON b.x >= a.x GROUP BY a.x, k.x)
SELECT x, round(max(v), 4) + 0.0 AS prediction FROM m GROUP BY x
"""


@query("isotonic_regression", ISOTONIC)
def _(spark, d):
    part = table(spark, d, "part")
    m = linear.IsotonicRegression.fit(part, "p_size", "p_retailprice", increasing=True)
    xs = part.select(F.col("p_size").cast("double").alias("x")).distinct()
    return rounded(m.predict(xs, "x").select("x", "prediction"), 4)


def _wide(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """The embeddings with a column a component, and the names of these."""
    e = embeddings(spark, d)
    cols = [f"f{k}" for k in range(e.select(F.max(F.size("features"))).first()[0])]
    return e.select("id", "label", *[F.col("features")[k].alias(c) for k, c in enumerate(cols)]), cols


@query("logistic_regression")
def _(spark, d):
    e, cols = _wide(spark, d)
    return linear.LogisticRegression.fit(e, cols, "label", 10, alpha=0.01).predict(e).select("id", "prediction")


@query("svm")
def _(spark, d):
    e, cols = _wide(spark, d)
    return linear.SVM.fit(e, cols, "label", 10, learning_rate=0.5).predict(e).select("id", "prediction")


# Bayes and discriminants: x1, x2, x3 are whole numbers, c the class. All rows train; each distinct row is predicted.

B_SQL = """WITH b AS (SELECT l_quantity::INT % 7 AS x1, (round(l_discount * 100))::INT % 5 AS x2, (l_partkey % 4)::INT AS x3, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c FROM lineitem),
l AS (SELECT c, unnest([1, 2, 3]) AS j, unnest([x1, x2, x3]) AS x FROM b), u AS (SELECT x1, x2, x3, unnest([1, 2, 3]) AS j, unnest([x1, x2, x3]) AS x FROM (SELECT DISTINCT x1, x2, x3 FROM b)),
n AS (SELECT c, count(*)::DOUBLE AS n FROM b GROUP BY c), a AS (SELECT sum(n) AS n FROM n) """
PICK = ", s AS ({score}) SELECT {key}, k AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(jll, 9) DESC, k) AS r FROM s) WHERE r = 1"
BX = ["x1", "x2", "x3"]


def bayes_rows(spark: SparkSession, d: str) -> DataFrame:
    return lineitem(spark, d).select(*KEY, (F.col("l_quantity").cast("int") % 7).alias("x1"), (F.round(F.col("l_discount") * 100).cast("int") % 5).alias("x2"), (F.col("l_partkey") % 4).cast("int").alias("x3"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("c"))


def each_class(scores: Column | str) -> Column:
    """Position and score of each class. The outer form, as the other puts a filter on the scores below the distinct, where they are made for every row."""
    return F.posexplode_outer(scores)


def _bayes(model):
    return lambda spark, d: model(bayes_rows(spark, d)).predict(bayes_rows(spark, d).select(*BX).distinct())


JOINT = "SELECT x1, x2, x3, m.c AS k, {base} + sum({term}) AS jll FROM u JOIN m ON m.j = u.j {more} GROUP BY x1, x2, x3, m.c{group}"
query("gaussian_nb", B_SQL + ", v AS (SELECT 1e-9 * max(v) AS v FROM (SELECT var_pop(x) AS v FROM l GROUP BY j)), m AS (SELECT l.c, j, avg(x) AS mu, var_pop(x) + max(v.v) AS s, max(n.n / a.n) AS p FROM l JOIN n ON n.c = l.c, a, v GROUP BY l.c, j)" + PICK.format(key="x1, x2, x3", score=JOINT.format(base="ln(max(m.p))", term="-0.5 * ln(2 * pi() * s) - 0.5 * (x - mu) * (x - mu) / s", more="", group="")))(_bayes(lambda t: bayes.GaussianNB.fit(t, BX, "c")))
query("multinomial_nb", B_SQL + ", m AS (SELECT l.c, j, ln((sum(x) + 1) / (sum(sum(x) + 1) OVER (PARTITION BY l.c))) AS f, max(n.n / a.n) AS p FROM l JOIN n ON n.c = l.c, a GROUP BY l.c, j)" + PICK.format(key="x1, x2, x3", score=JOINT.format(base="ln(max(m.p))", term="x * f", more="", group="")))(_bayes(lambda t: bayes.MultinomialNB.fit(t, BX, "c")))
query("complement_nb", B_SQL + ", t AS (SELECT c, j, sum(x) AS x FROM l GROUP BY c, j), q AS (SELECT c, j, sum(x) OVER (PARTITION BY j) + 1 - x AS r FROM t), m AS (SELECT c, j, -ln(r / sum(r) OVER (PARTITION BY c)) AS f FROM q)" + PICK.format(key="x1, x2, x3", score=JOINT.format(base="0", term="x * f", more="", group="")))(_bayes(lambda t: bayes.ComplementNB.fit(t, BX, "c")))
query("bernoulli_nb", B_SQL + ", m AS (SELECT l.c, j, (sum((x > 0)::INT) + 1) / (max(n.n) + 2) AS f, max(n.n / a.n) AS p FROM l JOIN n ON n.c = l.c, a GROUP BY l.c, j)" + PICK.format(key="x1, x2, x3", score=JOINT.format(base="ln(max(m.p))", term="x * ln(f) + (1 - x) * ln(1 - f)", more="", group="")))(_bayes(lambda t: bayes.BernoulliNB.fit(t, BX, "c")))
query("categorical_nb", B_SQL + ", z AS (SELECT j, max(x) + 1 AS z FROM l GROUP BY j), m AS (SELECT d.c, d.j, d.x AS v, ln((count(l.x) + 1) / (sum(count(l.x) + 1) OVER (PARTITION BY d.c, d.j))) AS f, max(n.n / a.n) AS p FROM (SELECT n.c, z.j, g.x FROM n, z, generate_series(0, 6) AS g(x) WHERE g.x < z.z) d LEFT JOIN l ON l.c = d.c AND l.j = d.j AND l.x = d.x JOIN n ON n.c = d.c, a GROUP BY d.c, d.j, d.x)" + PICK.format(key="x1, x2, x3", score=JOINT.format(base="ln(max(m.p))", term="f", more="AND m.v = u.x", group="")))(_bayes(lambda t: bayes.CategoricalNB.fit(t, BX, "c")))
query("multinomial_nb_probability", B_SQL + ", m AS (SELECT l.c, j, ln((sum(x) + 1) / (sum(sum(x) + 1) OVER (PARTITION BY l.c))) AS f, max(n.n / a.n) AS p FROM l JOIN n ON n.c = l.c, a GROUP BY l.c, j), s AS (" + JOINT.format(base="ln(max(m.p))", term="x * f", more="", group="") + ") SELECT x1, x2, x3, k::BIGINT AS k, round(exp(jll) / sum(exp(jll)) OVER (PARTITION BY x1, x2, x3), 6) + 0.0 AS p FROM s")(
    lambda spark, d: bayes.MultinomialNB.fit(bayes_rows(spark, d), BX, "c").predict_probability(bayes_rows(spark, d).select(*BX).distinct()).select(*BX, each_class("probability").alias("k", "p")).select(*BX, F.col("k").cast("long"), rd("p").alias("p"))
)
DISC = """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount * 100 AS b, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c FROM lineitem),
g AS (SELECT c, count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab FROM r GROUP BY c), t AS (SELECT sum(n) AS n, sum(n * aa) / (sum(n) - 3) AS aa, sum(n * bb) / (sum(n) - 3) AS bb, sum(n * ab) / (sum(n) - 3) AS ab FROM g)"""
MAHAL = "(({bb}) * (a - ma) ** 2 - 2 * ({ab}) * (a - ma) * (b - mb) + ({aa}) * (b - mb) ** 2) / (({aa}) * ({bb}) - ({ab}) ** 2)"
query("linear_discriminant", DISC + PICK.format(key="a, b", score="SELECT a, b, g.c AS k, ln(g.n / t.n) - 0.5 * " + MAHAL.format(aa="t.aa", bb="t.bb", ab="t.ab") + " AS jll FROM (SELECT DISTINCT a, b FROM r), g, t"))(lambda spark, d: bayes.LinearDiscriminant.fit(_two(spark, d), ["a", "b"], "c").predict(_two(spark, d).select("a", "b").distinct()))
query("quadratic_discriminant", DISC + PICK.format(key="a, b", score="SELECT a, b, g.c AS k, ln(g.n / t.n) - 0.5 * ln((g.aa * g.bb - g.ab ** 2) * (g.n / (g.n - 1)) ** 2) - 0.5 * " + MAHAL.format(aa="g.aa * g.n / (g.n - 1)", bb="g.bb * g.n / (g.n - 1)", ab="g.ab * g.n / (g.n - 1)") + " AS jll FROM (SELECT DISTINCT a, b FROM r), g, t"))(lambda spark, d: bayes.QuadraticDiscriminant.fit(_two(spark, d), ["a", "b"], "c").predict(_two(spark, d).select("a", "b").distinct()))

# Joint logarithms, log-probabilities and probabilities of every class, from the same scores as the predictions above.


def _probabilities_sql(name: str, key: str, joint: bool = True) -> str:
    head = ORACLE_SQL[name].rsplit(f") SELECT {key}, k AS prediction", 1)[0]
    columns = "round(jll, 5) + 0.0 AS jll, round(jll - ln(sum(exp(jll)) OVER w), 5) + 0.0 AS log_probability, " if joint else ""
    return f"{head}) SELECT {key}, k::BIGINT AS k, {columns}round(exp(jll) / sum(exp(jll)) OVER w, 5) + 0.0 AS probability FROM s WINDOW w AS (PARTITION BY {key})"


def _probabilities(model, rows: DataFrame, key: list[str], joint: bool = True) -> DataFrame:
    out = model.predict_probability(model.predict_log_probability(model.predict_joint_log_probability(rows.select(*key).distinct())))
    each = out.select(*key, F.posexplode(F.arrays_zip("jll", "log_probability", "probability")).alias("k", "s"))
    return each.select(*key, F.col("k").cast("long").alias("k"), *[rd(f"s.{c}", 5).alias(c) for c in (("jll", "log_probability", "probability") if joint else ("probability",))])


for _name, _model in {"gaussian_nb": bayes.GaussianNB, "bernoulli_nb": bayes.BernoulliNB, "categorical_nb": bayes.CategoricalNB, "complement_nb": bayes.ComplementNB, "multinomial_nb": bayes.MultinomialNB}.items():
    query(f"{_name}_probabilities", _probabilities_sql(_name, "x1, x2, x3"))(lambda spark, d, m=_model: _probabilities(m.fit(bayes_rows(spark, d), BX, "c"), bayes_rows(spark, d), BX))
for _name, _model in {"linear_discriminant": bayes.LinearDiscriminant, "quadratic_discriminant": bayes.QuadraticDiscriminant}.items():
    query(f"{_name}_probabilities", _probabilities_sql(_name, "a, b", False))(lambda spark, d, m=_model: _probabilities(m.fit(_two(spark, d), ["a", "b"], "c"), _two(spark, d), ["a", "b"], False))


@query("correlation_given_means", "WITH c AS (SELECT [l_quantity - 20, l_extendedprice - 30000, l_discount - 0.04] AS v FROM lineitem), s AS (SELECT i, j, sum(v[i + 1] * v[j + 1]) AS s FROM c, generate_series(0, 2) AS a(i), generate_series(0, 2) AS b(j) GROUP BY i, j) SELECT s.i::INT AS i, s.j::INT AS j, round(s.s / sqrt(p.s * q.s), 6) + 0.0 AS v FROM s JOIN s p ON p.i = s.i AND p.j = s.i JOIN s q ON q.i = s.j AND q.j = s.j")
def _(spark, d):
    return rounded(stats.correlation_matrix(lineitem(spark, d), NUM, [20.0, 30000.0, 0.04]))


# Decomposition.

EIGEN = "WITH r AS (SELECT l_quantity AS a, l_extendedprice / 1000 AS b FROM lineitem), c AS (SELECT var_samp(a) AS x, var_samp(b) AS y, covar_samp(a, b) AS z FROM r) "


def _pca_rows(spark: SparkSession, d: str) -> DataFrame:
    return lineitem(spark, d).select(*KEY, F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))


@query("pca", EIGEN + "SELECT round((x + y) / 2 + sqrt((x - y) ** 2 / 4 + z * z), 5) + 0.0 AS v1, round((x + y) / 2 - sqrt((x - y) ** 2 / 4 + z * z), 5) + 0.0 AS v2, round(((x + y) / 2 + sqrt((x - y) ** 2 / 4 + z * z)) / (x + y), 6) + 0.0 AS ratio FROM c")
def _(spark, d):
    m = decomposition.PCA.fit(_pca_rows(spark, d), ["a", "b"], 2)
    return spark.createDataFrame([(float(m.explained_variance[0]), float(m.explained_variance[1]), float(m.explained_variance_ratio[0]))], "v1 double, v2 double, ratio double").select(rd("v1", 5).alias("v1"), rd("v2", 5).alias("v2"), rd("ratio").alias("ratio"))


@query("pca_transform", EIGEN + ", w AS (SELECT z AS p, (x + y) / 2 + sqrt((x - y) ** 2 / 4 + z * z) - x AS q FROM c) SELECT round(min(abs(u)), 4) + 0.0 AS low, round(max(abs(u)), 4) + 0.0 AS high, round(avg(abs(u)), 4) + 0.0 AS mean FROM (SELECT ((a - ma) * p + (b - mb) * q) / sqrt(p * p + q * q) AS u FROM r, w, (SELECT avg(a) AS ma, avg(b) AS mb FROM r))")
def _(spark, d):
    u = F.abs(F.col("pca")[0])
    return rounded(decomposition.PCA.fit_transform(_pca_rows(spark, d), ["a", "b"], 2).agg(F.min(u).alias("low"), F.max(u).alias("high"), F.avg(u).alias("mean")), 4)


@query("pca_incremental", EIGEN + "SELECT round((x + y) / 2 + sqrt((x - y) ** 2 / 4 + z * z), 5) + 0.0 AS v1, round((x + y) / 2 - sqrt((x - y) ** 2 / 4 + z * z), 5) + 0.0 AS v2 FROM c")
def _(spark, d):
    t = _pca_rows(spark, d)
    m = decomposition.PCA.incremental_fit([t.where(F.col("l_orderkey") % 3 == k) for k in range(3)], ["a", "b"], 2)
    return rounded(spark.createDataFrame([tuple(map(float, m.explained_variance))], "v1 double, v2 double"), 5)


@query("truncated_svd", "WITH c AS (SELECT sum(l_quantity ** 2) AS x, sum((l_extendedprice / 1000) ** 2) AS y, sum(l_quantity * l_extendedprice / 1000) AS z FROM lineitem) SELECT round(sqrt((x + y) / 2 + sqrt((x - y) ** 2 / 4 + z * z)), 4) + 0.0 AS s1, round(sqrt((x + y) / 2 - sqrt((x - y) ** 2 / 4 + z * z)), 4) + 0.0 AS s2 FROM c")
def _(spark, d):
    m = decomposition.TruncatedSVD.fit(_pca_rows(spark, d), ["a", "b"], 2)
    return rounded(spark.createDataFrame([tuple(map(float, m.singular_values))], "s1 double, s2 double"), 4)


# A singular value is never negative; the correlation's sign is that of the weight of y.
@query("pls_svd", "SELECT 1.0 AS x_weight, sign(c) + 0.0 AS y_weight, round(abs(c), 6) + 0.0 AS covariance FROM (SELECT covar_samp(l_quantity, l_extendedprice) / (stddev_samp(l_quantity) * stddev_samp(l_extendedprice)) AS c FROM lineitem)")
def _(spark, d):
    t = lineitem(spark, d)
    m = decomposition.PLSSVD.fit(t, ["l_quantity"], ["l_extendedprice"], 1)
    s = m.transform(t).agg(F.covar_samp(F.col("x_scores")[0], F.col("y_scores")[0]).alias("covariance"))
    return rounded(s.select(F.lit(float(m.x_weights[0, 0])).alias("x_weight"), F.lit(float(m.y_weights[0, 0])).alias("y_weight"), "covariance"))


@query("kernel_pca")
def _(spark, d):
    e, cols = _wide(spark, d)
    return decomposition.KernelPCA.fit_transform(e, "id", cols, 2, kernel="rbf")


# Clustering.


def _kmeans_sql(k: int, rounds: int) -> str:
    ctes = [f"c0 AS (SELECT id::BIGINT AS k, v FROM e WHERE id < {k})"]
    for r in range(rounds):
        ctes.append(f"a{r} AS (SELECT id, v, k FROM (SELECT e.id, e.v, c.k, row_number() OVER (PARTITION BY e.id ORDER BY list_distance(e.v, c.v), c.k) AS n FROM e, c{r} c) WHERE n = 1)")
        ctes.append(f"l{r} AS (SELECT k, j, avg(x) AS x FROM (SELECT k, unnest(v) AS x, unnest(range(len(v))) AS j FROM a{r}) GROUP BY k, j)")
        ctes.append(f"c{r + 1} AS (SELECT k, list(x ORDER BY j) AS v FROM l{r} GROUP BY k)")
    return E_SQL + ", " + ", ".join(ctes) + f" SELECT id, k::INT AS cluster FROM (SELECT e.id, c.k, row_number() OVER (PARTITION BY e.id ORDER BY list_distance(e.v, c.v), c.k) AS n FROM e, c{rounds} c) WHERE n = 1"


@query("kmeans", _kmeans_sql(5, 3))
def _(spark, d):
    e = embeddings(spark, d)
    first = np.array([r["features"] for r in e.where("id < 5").orderBy("id").collect()])
    return clustering.KMeans.fit(e, 5, init=first, max_iterations=3, tol=1e-30).predict(e).select("id", "cluster")


@query("kmeans_transform", E_SQL + "SELECT e.id, c.id AS k, round(list_distance(e.v, c.v), 5) + 0.0 AS d FROM e, e c WHERE c.id < 5")
def _(spark, d):
    e = embeddings(spark, d)
    first = np.array([r["features"] for r in e.where("id < 5").orderBy("id").collect()])
    out = clustering.KMeansModel(first, 0.0, 0).transform(e)
    return out.select("id", F.posexplode("distances").alias("k", "d")).select("id", F.col("k").cast("long").alias("k"), rd("d", 5).alias("d"))


DBSCAN_SQL = E_SQL + """, p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON list_distance(a.v, b.v) <= 0.9),
k AS (SELECT a AS id FROM p GROUP BY a HAVING count(*) >= 4), q AS (SELECT a, b FROM p WHERE a IN (SELECT id FROM k) AND b IN (SELECT id FROM k)),
t AS (WITH RECURSIVE t(x, y) AS (SELECT id, id FROM k UNION SELECT t.x, q.b FROM t JOIN q ON t.y = q.a) SELECT x, min(y) AS m FROM t GROUP BY x),
n AS (SELECT x, (dense_rank() OVER (ORDER BY m) - 1)::INT AS label FROM t), b AS (SELECT p.a AS id, min(n.label) AS label FROM p JOIN n ON n.x = p.b GROUP BY p.a)
SELECT e.id, e.id IN (SELECT id FROM k) AS core, coalesce(n.label, b.label, -1) AS label FROM e LEFT JOIN n ON n.x = e.id LEFT JOIN b ON b.id = e.id"""


@query("dbscan", DBSCAN_SQL)
def _(spark, d):
    return clustering.DBSCAN.fit(embeddings(spark, d), 0.9, 4)


@query("silhouette", E_SQL + ", s AS (SELECT a.id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM e a, e b GROUP BY ALL), m AS (SELECT id, max(own) AS label, max(CASE WHEN own = other THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM s GROUP BY id) SELECT id, label::BIGINT AS label, round((b - a) / greatest(a, b), 5) + 0.0 AS silhouette FROM m")
def _(spark, d):
    return rounded(clustering.silhouette_samples(embeddings(spark, d), "label"), 5)


@query("silhouette_score", E_SQL + ", s AS (SELECT a.id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM e a, e b GROUP BY ALL), m AS (SELECT id, max(CASE WHEN own = other THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM s GROUP BY id) SELECT round(avg((b - a) / greatest(a, b)), 6) + 0.0 AS silhouette FROM m")
def _(spark, d):
    return rounded(clustering.silhouette_score(embeddings(spark, d), "label"))


query("gaussian_mixture")(lambda spark, d: clustering.GaussianMixture.fit(embeddings(spark, d), 3).predict(embeddings(spark, d)))
query("optics")(lambda spark, d: clustering.OPTICS.fit(embeddings(spark, d), 5, eps=0.3))
query("hdbscan")(lambda spark, d: clustering.HDBSCAN.fit(embeddings(spark, d)))
query("hierarchical")(lambda spark, d: clustering.Hierarchical.frame(embeddings(spark, d), clustering.Hierarchical.fit(embeddings(spark, d), "ward")))
query("spectral_clustering")(lambda spark, d: clustering.SpectralClustering.fit(embeddings(spark, d), 3))


@query("hierarchical_single", E_SQL + """, p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON list_distance(a.v, b.v) < 0.8),
t AS (WITH RECURSIVE t(x, y) AS (SELECT id, id FROM e UNION SELECT t.x, p.b FROM t JOIN p ON t.y = p.a) SELECT x, min(y) AS m FROM t GROUP BY x)
SELECT x AS id, m AS cluster FROM t""")
def _(spark, d):
    e = embeddings(spark, d)
    tree = clustering.Hierarchical.fit(e, "single")
    low: dict[int, int] = {}
    labels = tree.labels(height=0.8)
    for i, c in zip(tree.ids.tolist(), labels.tolist()):
        low[c] = min(low.get(c, i), i)
    return spark.createDataFrame([(i, low[c]) for i, c in zip(tree.ids.tolist(), labels.tolist())], "id long, cluster long")


@query("hierarchical_labels_map", E_SQL + """, p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON list_distance(a.v, b.v) < 0.8),
t AS (WITH RECURSIVE t(x, y) AS (SELECT id, id FROM e UNION SELECT t.x, p.b FROM t JOIN p ON t.y = p.a) SELECT x, min(y) AS m FROM t GROUP BY x)
SELECT (dense_rank() OVER (ORDER BY m) - 1)::BIGINT AS cluster, x AS id FROM t""")
def _(spark, d):
    tree = clustering.Hierarchical.fit(embeddings(spark, d), "single")
    return spark.createDataFrame([(c, i) for c, own in tree.labels_map(height=0.8).items() for i in own], "cluster long, id long")


@query("affinity_propagation")
def _(spark, d):
    m = clustering.AffinityPropagation.fit(embeddings(spark, d)).prune()
    return m.predict(embeddings(spark, d)).select("id", "label") if len(m.exemplars) else clustering.labelled(embeddings(spark, d), m.ids, m.labels)


# Interpolation and integration.

KNOTS = "k AS (SELECT p_size::DOUBLE AS x, avg(p_retailprice) AS y FROM part WHERE p_size % 5 = 0 GROUP BY 1), t AS (SELECT DISTINCT p_size::DOUBLE AS x FROM part WHERE p_size BETWEEN 5 AND 50)"


def _knots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, d, "part")
    k = part.where("p_size % 5 = 0").groupBy(F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    return k, part.where("p_size between 5 and 50").select(F.col("p_size").cast("double").alias("x")).distinct()


SEGMENT = f"WITH {KNOTS}, s AS (SELECT *, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM k) SELECT x, round(min(y), 4) + 0.0 AS y FROM (SELECT t.x, s.y + (s.y2 - s.y) * (t.x - s.x) / (s.x2 - s.x) AS y FROM t JOIN s ON t.x BETWEEN s.x AND s.x2) GROUP BY x"


@query("interpolation_linear", SEGMENT)
def _(spark, d):
    k, t = _knots(spark, d)
    return rounded(interpolation.LinearInterpolation.fit(k, "x", "y").predict(t, "x", "y"), 4)


@query("interpolation_linear_windowed", SEGMENT)
def _(spark, d):
    k, t = _knots(spark, d)
    return rounded(interpolation.interpolate_linear(t.withColumn("g", F.lit(1)), k.withColumn("g", F.lit(1)), "x", "y", ["g"]).select("x", "y"), 4)


PCHIP = f"""WITH {KNOTS}, h AS (SELECT *, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS d, x - lag(x) OVER w AS h0, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS d0, row_number() OVER w AS i, count(*) OVER () AS n FROM k WINDOW w AS (ORDER BY x)),
g AS (SELECT *, lead(h) OVER w AS h2, lead(d) OVER w AS d2, lag(h0) OVER w AS hh, lag(d0) OVER w AS dd FROM h WINDOW w AS (ORDER BY x)),
e AS (SELECT *, CASE WHEN i = 1 THEN ((2 * h + h2) * d - h * d2) / (h + h2) WHEN i = n THEN ((2 * h0 + hh) * d0 - h0 * dd) / (h0 + hh) END AS r, CASE WHEN i = 1 THEN d ELSE d0 END AS da, CASE WHEN i = 1 THEN d2 ELSE dd END AS db FROM g),
m AS (SELECT x, y, h, d, CASE WHEN i > 1 AND i < n THEN CASE WHEN d0 * d > 0 THEN 3 * (h0 + h) / ((2 * h + h0) / d0 + (h + 2 * h0) / d) ELSE 0 END
 WHEN sign(r) <> sign(da) THEN 0 WHEN sign(da) <> sign(db) AND abs(r) > 3 * abs(da) THEN 3 * da ELSE r END AS m FROM e),
s AS (SELECT *, lead(x) OVER (ORDER BY x) AS x2, lead(m) OVER (ORDER BY x) AS m2 FROM m)
SELECT t.x, round(min(s.y + s.m * u + (3 * s.d - 2 * s.m - s.m2) / s.h * u * u + (s.m + s.m2 - 2 * s.d) / (s.h * s.h) * u * u * u), 4) + 0.0 AS y FROM t JOIN s ON t.x BETWEEN s.x AND s.x2, LATERAL (SELECT t.x - s.x AS u) GROUP BY t.x"""


@query("interpolation_monotonic", PCHIP)
def _(spark, d):
    k, t = _knots(spark, d)
    return rounded(interpolation.MonotonicCubicSpline.fit(k, "x", "y").predict(t, "x", "y"), 4)


@query("cubic_spline_at_knots", f"WITH {KNOTS} SELECT x, round(y, 4) + 0.0 AS y FROM k")
def _(spark, d):
    k, _ = _knots(spark, d)
    return rounded(interpolation.CubicSpline.fit(k, "x", "y").predict(k.select("x"), "x", "y"), 4)


@query("bezier_spline_at_knots", f"WITH {KNOTS} SELECT x, round(y, 2) + 0.0 AS y FROM k")
def _(spark, d):
    k, _ = _knots(spark, d)
    return rounded(interpolation.BezierSpline.fit(k, "x", "y").predict(k.select("x"), "x", "y"), 2)


# Away from the knots, with knots on curves that these splines reproduce: a cubic, and a line.


def _on_curve(spark: SparkSession, d: str, y: Column) -> tuple[DataFrame, DataFrame]:
    k, t = _knots(spark, d)
    return k.withColumn("y", y), t


@query("cubic_spline", f"WITH {KNOTS} SELECT x, round(x ** 3 / 50 - x ** 2 / 3 + 2 * x - 7, 4) + 0.0 AS y FROM t WHERE x BETWEEN (SELECT min(x) FROM k) AND (SELECT max(x) FROM k)")
def _(spark, d):
    x = F.col("x")
    k, t = _on_curve(spark, d, F.pow(x, 3) / 50 - F.pow(x, 2) / 3 + 2 * x - 7)
    out = interpolation.CubicSpline.fit(k, "x", "y").predict(t, "x", "y", extrapolate=False)
    return rounded(out.where(~F.isnan("y")), 4)


@query("bezier_spline", f"WITH {KNOTS} SELECT x, round(1.5 * x - 4, 4) + 0.0 AS y FROM t WHERE x BETWEEN (SELECT min(x) FROM k) AND (SELECT max(x) FROM k)")
def _(spark, d):
    k, t = _on_curve(spark, d, 1.5 * F.col("x") - 4)
    ends = k.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    return rounded(interpolation.BezierSpline.fit(k, "x", "y").predict(t.where(F.col("x").between(ends["a"], ends["b"])), "x", "y"), 4)


@query("asof_join", "SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def _(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return interpolation.asof(table(spark, d, "events").select("event_id", "user_id", "ts"), o, "ts", ["user_id"], ["o_orderkey"]).select("event_id", "o_orderkey")


EV = "WITH v AS (SELECT user_id, event_id::DOUBLE AS x, value AS y FROM events) "


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))


query("trapezoidal", EV + "SELECT user_id, round(coalesce(sum(a), 0), 4) + 0.0 AS integral FROM (SELECT user_id, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM v WINDOW w AS (PARTITION BY user_id ORDER BY x)) GROUP BY user_id")(lambda spark, d: rounded(integrate.trapezoidal(_events(spark, d), "x", "y", ["user_id"]), 4))
query("trapezoidal_uniform", EV + "SELECT user_id, round(0.5 * (sum(y) - (arg_min(y, x) + arg_max(y, x)) / 2), 5) + 0.0 AS integral FROM v GROUP BY user_id")(lambda spark, d: rounded(integrate.trapezoidal_uniform(_events(spark, d), "x", "y", 0.5, ["user_id"]), 5))
SIMPSON = EV + """, s AS (SELECT user_id, y, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, lead(y) OVER w AS y1, lead(y, 2) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY user_id ORDER BY x)),
a AS (SELECT user_id, CASE WHEN i % 2 = 1 AND i <= n - 2 THEN 0.5 / 3 * (y + 4 * y1 + y2) ELSE 0 END + CASE WHEN n % 2 = 0 AND i = n - 1 THEN 0.25 * (y + y1) ELSE 0 END AS f FROM s) SELECT user_id, round(sum(f), 5) + 0.0 AS integral FROM a GROUP BY user_id"""
query("simpson_uniform", SIMPSON)(lambda spark, d: rounded(integrate.simpson_uniform(_events(spark, d), "x", "y", 0.5, "first", ["user_id"]), 5))
UNEVEN = EV + """, s AS (SELECT user_id, x, y, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, lead(x) OVER w - x AS h0, lead(x, 2) OVER w - lead(x) OVER w AS h1, lead(y) OVER w AS y1, lead(y, 2) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY user_id ORDER BY x)),
a AS (SELECT *, (h0 + h1) / 6 * ((2 - h1 / h0) * y + (h0 + h1) ** 2 / (h0 * h1) * y1 + (2 - h0 / h1) * y2) AS area, h0 * (y + y1) / 2 AS step FROM s),
f AS (SELECT user_id, CASE WHEN i % 2 = 1 AND i <= n - 2 THEN area ELSE 0 END + CASE WHEN n % 2 = 0 AND i = n - 1 THEN step ELSE 0 END AS f,
  CASE WHEN (i + n) % 2 = 0 AND i <= n - 2 THEN area ELSE 0 END + CASE WHEN n % 2 = 0 AND i = 1 THEN step ELSE 0 END AS l FROM a)
SELECT user_id, round((sum(f) + sum(l)) / 2, 4) + 0.0 AS integral FROM f GROUP BY user_id"""
query("simpson", UNEVEN)(lambda spark, d: rounded(integrate.simpson(_events(spark, d), "x", "y", "avg", ["user_id"]), 4))

# Model selection, optimisers, manifolds.


@query("k_fold", "SELECT fold, count(*) AS n, min(c_custkey) AS low, max(c_custkey) AS high FROM (SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) // (count(*) OVER () // 7))::INT AS fold FROM customer) WHERE fold < 7 GROUP BY fold")
def _(spark, d):
    f = model_selection.with_folds(table(spark, d, "customer"), 7, "c_custkey")
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))


CV = """WITH f AS (SELECT ((row_number() OVER (ORDER BY p_partkey) - 1) // (count(*) OVER () // 4))::INT AS fold, p_size::DOUBLE AS x, p_retailprice AS y FROM part),
m AS (SELECT g.fold, regr_slope(f.y, f.x) AS a, regr_intercept(f.y, f.x) AS b FROM f JOIN (SELECT fold::INT AS fold FROM generate_series(0, 3) AS s(fold)) g ON f.fold <> g.fold AND f.fold < 4 GROUP BY g.fold)
SELECT m.fold, round(avg(abs(f.y - a * f.x - b)), 4) + 0.0 AS mae FROM m JOIN f ON f.fold = m.fold GROUP BY m.fold"""


@query("cross_validate", CV)
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))

    def score(train: DataFrame, test: DataFrame) -> list[float]:
        return [regression.mean_absolute_error(linear.LinearRegression.fit(train, ["x"], "y").predict(test), "y", "prediction").first()[0]]

    s = model_selection.cross_validate(part, lambda t: model_selection.k_fold_split(t, 4, "p_partkey"), score)
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in enumerate(s[0])], "fold int, mae double"), 4)


GRID = """WITH f AS (SELECT ((row_number() OVER (ORDER BY p_partkey) - 1) // (count(*) OVER () // 3))::INT AS fold, p_size::DOUBLE AS x, p_retailprice AS y FROM part),
o AS (SELECT unnest([0.1, 10.0]) AS alpha), g AS (SELECT fold::INT AS fold FROM generate_series(0, 2) AS s(fold)),
m AS (SELECT alpha, g.fold, covar_pop(f.x, f.y) * count(*) / (var_pop(f.x) * count(*) + alpha) AS a, avg(f.x) AS mx, avg(f.y) AS my FROM f JOIN g ON f.fold <> g.fold AND f.fold < 3, o GROUP BY alpha, g.fold),
e AS (SELECT alpha, m.fold, avg((f.y - my - a * (f.x - mx)) ** 2) AS mse FROM m JOIN f ON f.fold = m.fold GROUP BY alpha, m.fold)
SELECT alpha::DOUBLE AS alpha, round(avg(mse), 3) + 0.0 AS mse FROM e GROUP BY alpha"""


@query("grid_search", GRID)
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))

    def score(train: DataFrame, test: DataFrame, o: dict) -> list[float]:
        return [regression.mean_square_error(linear.RidgeRegression.fit(train, ["x"], "y", o["alpha"]).predict(test), "y", "prediction").first()[0]]

    s = model_selection.grid_search(part, lambda t: model_selection.k_fold_split(t, 3, "p_partkey"), score, {"alpha": [0.1, 10.0]})
    return spark.createDataFrame([(o["alpha"], float(v[0])) for o, v in s], "alpha double, mse double").select("alpha", rd("mse", 3).alias("mse"))


WEIGHTED = """WITH f AS (SELECT ((row_number() OVER (ORDER BY p_partkey) - 1) // (count(*) OVER () // 4))::INT AS fold, p_size::DOUBLE AS x, p_retailprice AS y, (1 + p_partkey % 3)::DOUBLE AS w FROM part),
g AS (SELECT fold::INT AS fold FROM generate_series(0, 3) AS s(fold)), o AS (SELECT unnest([{alphas}]) AS alpha),
t AS (SELECT g.fold, sum(w) AS sw, sum(w * f.x) / sum(w) AS mx, sum(w * f.y) / sum(w) AS my FROM f JOIN g ON f.fold <> g.fold AND f.fold < 4 GROUP BY g.fold),
m AS (SELECT alpha, t.fold, mx, my, sum(w * (f.x - mx) * (f.y - my)) / (sum(w * (f.x - mx) ** 2) + alpha) AS a FROM f JOIN t ON f.fold <> t.fold AND f.fold < 4, o GROUP BY alpha, t.fold, mx, my),
e AS (SELECT alpha, m.fold, avg(abs(f.y - my - a * (f.x - mx))) AS mae FROM m JOIN f ON f.fold = m.fold GROUP BY alpha, m.fold) """


def _weighted_part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (1 + F.col("p_partkey") % 3).cast("double").alias("w"))


@query("weighted_cross_validate", WEIGHTED.format(alphas="0.0") + "SELECT fold, round(mae, 4) + 0.0 AS mae FROM e")
def _(spark, d):
    def score(train: DataFrame, test: DataFrame, weight: str) -> list[float]:
        return [regression.mean_absolute_error(linear.LinearRegression.fit(train, ["x"], "y", weight).predict(test), "y", "prediction").first()[0]]

    s = model_selection.weighted_cross_validate(_weighted_part(spark, d), "w", lambda t: model_selection.k_fold_split(t, 4, "p_partkey"), score)
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in enumerate(s[0])], "fold int, mae double"), 4)


@query("weighted_grid_search", WEIGHTED.format(alphas="0.5, 2000.0") + "SELECT alpha::DOUBLE AS alpha, 'w' AS weights, round(avg(mae), 4) + 0.0 AS mae FROM e GROUP BY alpha")
def _(spark, d):
    def score(train: DataFrame, test: DataFrame, weight: str, o: dict) -> list[float]:
        return [regression.mean_absolute_error(linear.RidgeRegression.fit(train, ["x"], "y", o["alpha"], weight).predict(test), "y", "prediction").first()[0]]

    s = model_selection.weighted_grid_search(_weighted_part(spark, d), ["w"], lambda t: model_selection.k_fold_split(t, 4, "p_partkey"), score, {"alpha": [0.5, 2000.0]})
    return rounded(spark.createDataFrame([(o["alpha"], o["weights"], float(v[0])) for o, v in s], "alpha double, weights string, mae double"), 4)


def _minimum(spark: SparkSession, x: float) -> DataFrame:
    return spark.createDataFrame([(round(float(x), 3) + 0.0,)], "x double")


# The value that minimises the mean squared distance is the mean; the objective is an aggregation of three sums.
MEAN = "SELECT round(avg(s_acctbal / 1000), 3) + 0.0 AS x FROM supplier"


def _objective(spark: SparkSession, d: str):
    a = F.col("s_acctbal") / 1000
    r = table(spark, d, "supplier").agg(F.avg(a).alias("m"), F.avg(a * a).alias("q")).first()
    return lambda x: float(r["q"] - 2 * x * r["m"] + x * x)


query("brent", MEAN)(lambda spark, d: _minimum(spark, optimize.Brent.minimize(-20.0, 20.0, _objective(spark, d), 1e-8).x))
query("golden_section", MEAN)(lambda spark, d: _minimum(spark, optimize.GoldenSection.minimize(-20.0, 20.0, _objective(spark, d), 1e-6).x))
query("bfgs", MEAN)(lambda spark, d: _minimum(spark, optimize.BFGS.minimize(np.array([3.0]), lambda z, f=_objective(spark, d): f(z[0])).x[0]))
query("nelder_mead", MEAN)(lambda spark, d: _minimum(spark, optimize.NelderMead.minimize(np.array([3.0]), lambda z, f=_objective(spark, d): f(z[0]), 1e-8).x[0]))
query("tsne")(lambda spark, d: manifold.TSNE.fit(embeddings(spark, d)))
query("mds")(lambda spark, d: manifold.MDS.fit(embeddings(spark, d))[0])
query("trimap")(lambda spark, d: manifold.Trimap.transform(embeddings(spark, d)))
