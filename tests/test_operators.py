"""Operators that SQL can't express, and their options: closed forms, numpy, invariants."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions import validation as V
from latticework.functions import vectors as X
from latticework.operators import bayes, classification, clustering, decomposition, integrate, interpolation, linear, manifold, model_selection, neighbors, optimize, preprocessing, regression, stats


def frame(spark, x, **extra):
    names = [f"f{k}" for k in range(x.shape[1])]
    rows = [(i, *map(float, r), [float(v) for v in r], *[e[i].item() if hasattr(e[i], "item") else e[i] for e in extra.values()]) for i, r in enumerate(x)]
    kinds = {float: "double", int: "int", str: "string"}
    more = [f"{n} {kinds[type(v[0].item() if hasattr(v[0], 'item') else v[0])]}" for n, v in extra.items()]
    return spark.createDataFrame(rows, ", ".join(["id long", *[f"{n} double" for n in names], "features array<double>", *more])), names


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    centers = np.array([[0, 0], [8, 0], [0, 8]])
    x = np.vstack([c + rng.normal(size=(20, 2)) * 0.5 for c in centers])
    y = np.repeat([0, 1, 2], 20)
    df, cols = frame(spark, x, label=y)
    return x, y, df.cache(), cols


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


# Options.


@pytest.mark.parametrize("check, good, bad", [
    (V.positive_number, [1, 0.5], [0, -1, "x", True]), (V.non_negative_number, [0, 2.5], [-1, None]), (V.non_negative_integer, [0, 3], [-1, 1.5]), (V.positive_integer, [1], [0, 1.0]),
    (V.quantile_range, [(25.0, 75.0)], [(75, 25), (0, 50), (1, 100), 3]), (V.axes, [None, [0, 1]], ["a"]), (V.axis, [0, -1], [None]), (V.column_type, ["int"], ["uuid"]), (V.seed, [3], [None]),
    (V.weights, [None, "w", [1, 2.0]], [[[1]]]), (V.multi_weights, [None, [[1], [2]]], [[1]]), (V.optimizer, ["adam", (len, len)], ["other", (1, 2)]), (V.beta, [0], [-1]), (V.loss_function, [len], [3]),
])
def test_options(check, good, bad):
    for g in good:
        assert check(g) == g
    for b in bad:
        with pytest.raises(ValueError):
            check(b)


def test_shapes(spark):
    df = spark.createDataFrame([(1, [1.0])], "a int, b array<double>")
    V.assert_rank(df, "b", 2)
    with pytest.raises(ValueError):
        V.assert_rank(df, "a", 2)
    assert V.valid_broadcast(2, (3, 1), (1, 4)) == (3, 4)
    with pytest.raises(ValueError):
        V.valid_broadcast(2, (3, 2), (1, 4))


# Preprocessing, statistics.


def test_scalers_of_constants(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "a double")
    assert preprocessing.StandardScaler.fit_transform(df, ["a"]).first()[0] == 5.0
    assert preprocessing.MinMaxScaler.fit_transform(df, ["a"], min_bound=2, max_bound=3).first()[0] == 2.0
    with pytest.raises(ValueError):
        preprocessing.MinMaxScaler.fit(df, ["a"], min_bound=1, max_bound=1)


def test_pooled_scaler(spark):
    x = np.array([[1.0, -1, 2], [2, 0, 0], [0, 1, -1]])
    df, cols = frame(spark, x)
    got = np.array(preprocessing.standard_scale(df, cols).orderBy("id").select(*cols).collect())
    assert np.allclose(got, (x - x.mean()) / x.std())


def test_one_hot_of_unseen(spark):
    m = preprocessing.OneHotEncoder.fit(spark.createDataFrame([("a",), ("b",)], "c string"), "c")
    out = preprocessing.OneHotEncoder.transform(m, spark.createDataFrame([("b",), ("z",)], "c string"), "h").collect()
    assert [r.h for r in out] == [[0, 1], [0, 0]]


def test_gram_by_group(spark, blobs):
    x, y, df, cols = blobs
    for g, s in stats.gram(df, cols, None, "label").items():
        assert np.allclose(s.covariance(1), np.cov(x[y == g].T))
        assert np.allclose(s.mean, x[y == g].mean(0))


def test_partitions_do_not_matter(spark, blobs):
    x, y, df, cols = blobs
    a, b = (stats.gram(df.repartition(n), cols)[None].covariance() for n in (1, 7))
    assert np.allclose(a, b)


# Metrics.


def test_curves_over_many_ranges(spark):
    rng = np.random.default_rng(1)
    s, y = np.round(rng.uniform(size=3000), 3), rng.integers(0, 2, 3000)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
    assert abs(classification.roc_auc_score(df, "y", "s").first()[0] - auc) < 1e-12
    assert classification.roc_curve(df, "y", "s").count() == len(set(s)) + 1


def test_mcc_edges(spark):
    df = spark.createDataFrame([(1, 0), (0, 1)], "y int, p int")
    assert classification.mcc(df, "y", "p").first()[0] == -1
    assert classification.binary_precision(df.where("y = 1"), "y", "p").first()[0] == 0


def test_tweedie_domain(spark):
    df = spark.createDataFrame([(0.0, 1.0)], "y double, p double")
    with pytest.raises(ValueError):
        regression.mean_tweedie_deviance_checked(df, "y", "p", 2)
    with pytest.raises(ValueError):
        regression.mean_tweedie_deviance_checked(df, "y", "p", 0.5)


def test_dcg_by_hand(spark):
    rel, score = [1, 4, 0, 2, 5, 3, 1], [0.4, 7.1, 2.6, 5.0, 4.2, 0.9, 6.3]
    df = spark.createDataFrame(list(zip(rel, score)), "r int, s double")
    order = sorted(zip(score, rel), reverse=True)
    assert abs(regression.dcg(df, "r", "s").first()[0] - sum(r / math.log2(k + 2) for k, (_, r) in enumerate(order))) < 1e-12


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [0.0, 0.0], [1.0, 0.0])], "z array<double>, o array<double>, e array<double>")
    r = df.select(X.cosine("z", "o"), X.cosine("z", "e"), X.pairwise_cosine_distance("z", "o")).first()
    assert tuple(r) == (0.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        X.metric("nope")


# Neighbours.


def test_kd_tree_order_and_search(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 10, 30):
        x = rng.uniform(size=(n, 3))
        order = neighbors.KDTree.permutation(x)
        assert sorted(order) == list(range(n))
        tree = neighbors.KDTree(order, x[order], min(3, n))
        for q in rng.uniform(size=(5, 3)):
            d = np.linalg.norm(x - q, axis=1)
            assert [i for _, i in tree.search(q)] == np.argsort(d)[: min(3, n)].tolist()
    assert [neighbors.levels(n) for n in (1, 3, 4)] == [1, 2, 3]
    assert (neighbors.parent(0), neighbors.parent(2), neighbors.left_child(1), neighbors.right_child(1)) == (-1, 0, 3, 4)


@pytest.mark.parametrize("metric", ["euclidean", "squared_euclidean", "manhattan", "chebyshev", "cosine", ("minkowski", 3)])
def test_block_distances_are_the_columns(spark, blobs, metric):
    x, y, df, cols = blobs
    named = neighbors.BruteKNN.fit(df, 4, metric=metric).predict(df).select("query_id", "rank", F.round("distance", 8)).collect()
    column = neighbors.BruteKNN.fit(df, 4, metric=X.pairwise_metric(metric)).predict(df).select("query_id", "rank", F.round("distance", 8)).collect()
    assert sorted(map(tuple, named)) == sorted(map(tuple, column))


def test_approximate_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    df, _ = frame(spark, rng.normal(size=(300, 6)))
    true = neighbors.BruteKNN.fit(df, 5, exclude_self=True).predict(df).cache()
    graph = neighbors.NNDescent.fit(df, 5, max_candidates=12, max_iterations=6)
    for got in (neighbors.LargeVis.fit(df, 5, num_iters=1), graph.graph, graph.query(df, 6).where("query_id <> neighbor_id")):
        assert neighbors.neighbors_recall(true, got).first()[0] >= 0.9


def test_kd_tree_in_step(spark):
    """All queries together, with equal points and distances, fewer points than neighbours, and every metric."""
    rng = np.random.default_rng(12)
    for n, dim, k in ((40, 2, 5), (200, 8, 3), (3, 2, 5)):
        x = rng.integers(0, 4, (n, dim)).astype(float)
        ids, q = rng.permutation(n), np.vstack([x, rng.integers(0, 4, (30, dim)) + 0.5])
        order = neighbors.KDTree.permutation(x)
        for metric in ("euclidean", "squared_euclidean", "manhattan", "chebyshev", "cosine", ("minkowski", 3)):
            d, found = neighbors.KDTree(ids[order], x[order], k, metric).search_many(q)
            true = neighbors.distances(q, x, metric)
            for r in range(len(q)):
                best = sorted(zip(true[r].tolist(), ids.tolist()))[:k]
                assert [i for i in found[r].tolist() if i >= 0] == [i for _, i in best] or np.allclose(sorted(d[r][found[r] >= 0]), [v for v, _ in best])
                assert (found[r] >= 0).sum() == min(n, k)


def test_search_graph(spark):
    """A prepared graph finds the neighbours of new points, and is smaller than both ways of the whole graph."""
    rng = np.random.default_rng(13)
    points, _ = frame(spark, rng.normal(size=(400, 5)))
    new, _ = frame(spark, rng.normal(size=(60, 5)))
    fitted = neighbors.NNDescent.fit(points, 8, max_candidates=20, max_iterations=5)
    graph = fitted.prepare()
    assert graph.edges.count() < 2 * fitted.graph.count()
    assert graph.edges.groupBy("n").count().agg(F.max("count")).first()[0] <= 24
    true = neighbors.BruteKNN.fit(points, 5, metric="squared_euclidean").predict(new)
    got = graph.query(new, 5)
    assert got.count() == 300
    assert neighbors.neighbors_recall(true, got).first()[0] >= 0.95
    assert neighbors.neighbors_recall(true, graph.query(new.limit(5), 5)).first()[0] >= 0.05  # the same graph again


def test_imputation_of_other_rows(spark):
    donors = spark.createDataFrame([(1, 0.0, 10.0), (2, 1.0, 20.0), (3, 9.0, 90.0)], "id long, a double, b double")
    new = spark.createDataFrame([(1, 8.0, None), (7, None, None), (8, 0.4, 5.0)], "id long, a double, b double")
    m = neighbors.KNNImputer.fit(donors, "id", ["a", "b"], 1)
    got = {r.id: (r.a, r.b) for r in m.transform(new).collect()}
    assert got[1] == (8.0, 90.0) and got[8] == (0.4, 5.0)
    assert got[7][0] is None or math.isnan(got[7][0])  # nothing in common with any donor


def test_sums_of_arrays(spark):
    from latticework.functions import sums

    rng = np.random.default_rng(14)
    x = rng.normal(size=(500, 3))
    df = spark.createDataFrame([(int(k % 4), r.tolist()) for k, r in enumerate(x)], "g int, s array<double>").repartition(37)
    got = sums.array_sums(df)
    assert sorted(got) == [0, 1, 2, 3]
    assert all(np.allclose(got[g], x[g::4].sum(0)) for g in got)
    part = lambda b: b.column(1).flatten().to_numpy().reshape(-1, 3).sum(0)
    assert np.allclose(sums.total(df, part), x.sum(0)) and np.allclose(sums.total(df, part, 37), x.sum(0)) and np.allclose(sums.total(df.coalesce(2), part, 2), x.sum(0))
    assert sums.array_sums(df.limit(0)) == {}


def test_targets(spark):
    df = spark.createDataFrame([(1.0, "a", [1.0])], "x double, s string, a array<double>")
    for y in ("s", "a", "nothing"):
        with pytest.raises(ValueError):
            linear.LinearRegression.fit(df, ["x"], y)


def test_curves_of_weights_and_of_one_class(spark):
    rng = np.random.default_rng(15)
    s, y, w = np.round(rng.normal(size=400), 1), rng.integers(0, 2, 400), rng.uniform(0.5, 2, 400)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(s, y, w)], "s double, y int, w double").repartition(5)
    p, n = y == 1, y == 0
    each = np.outer(w[p], w[n]) * ((s[p][:, None] > s[n]) + 0.5 * (s[p][:, None] == s[n]))
    assert abs(classification.roc_auc_score(df, "y", "s", "w").first()[0] - each.sum() / w[p].sum() / w[n].sum()) < 1e-12
    got = {r.threshold: (r.precision, r.recall) for r in classification.precision_recall_curve(df, "y", "s", "w").collect()}
    for t in set(s.tolist()):
        up = s >= t
        assert np.allclose(got[t], (w[up & p].sum() / w[up].sum(), w[up & p].sum() / w[p].sum()))
    assert math.isnan(classification.roc_auc_score(df.where("y = 1"), "y", "s").first()[0])
    assert classification.average_precision_score(df.where("y = 0"), "y", "s").first()[0] == 0


def test_distance_weights(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 2.0), (2, 4.0), (2, 0.5)], "query_id int, d double")
    w = df.select("query_id", "d", neighbors.inverse_distance_weights(F.col("d")).alias("w")).collect()
    assert sorted((r.query_id, r.d, r.w) for r in w) == [(1, 0.0, 1.0), (1, 2.0, 0.0), (2, 0.5, 2.0), (2, 4.0, 0.25)]


# Models.


def test_linear_models_match_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3))
    w = rng.uniform(0.5, 2, 80)
    y = x @ [1.5, -2, 0.5] + 3 + 0.1 * rng.normal(size=80)
    df, cols = frame(spark, x, y=y, w=w)
    a = np.hstack([x, np.ones((80, 1))]) * np.sqrt(w)[:, None]
    expect = np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0]
    m = linear.LinearRegression.fit(df, cols, "y", "w")
    assert np.allclose([*m.coefficients, m.intercept], expect)
    b = linear.BayesianRidgeRegression.fit(df, cols, "y", compute_scores=True)
    assert np.allclose(b.coefficients, [1.5, -2, 0.5], atol=0.1) and abs(1 / math.sqrt(b.alpha) - 0.1) < 0.05
    assert (np.diff(b.scores) >= -1e-6).all()
    twice = df.withColumn("f3", F.col("f0") * 2)
    assert np.allclose([r.prediction for r in linear.LinearRegression.fit(twice, [*cols, "f3"], "y").predict(twice).orderBy("id").collect()], [r.prediction for r in linear.LinearRegression.fit(df, cols, "y").predict(df).orderBy("id").collect()])


def test_isotonic(spark):
    rng = np.random.default_rng(5)
    x = rng.permutation(200) / 10
    y = np.sqrt(x) + 0.3 * rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = np.array([r.prediction for r in linear.IsotonicRegression.fit(df, "x", "y").predict(df, "x").orderBy("x").collect()])
    assert np.allclose(got, linear.pool_adjacent(y[np.argsort(x)], np.ones(200)))
    down = linear.IsotonicRegression.fit(df.withColumn("y", -F.col("y")), "x", "y", out_of_bounds="nan")
    assert not down.increasing
    assert math.isnan(down.predict(spark.createDataFrame([(-1.0,)], "x double"), "x").first().prediction)


def test_classifiers_on_blobs(spark, blobs):
    x, y, df, cols = blobs
    fits = [bayes.GaussianNB.fit(df, cols, "label"), bayes.LinearDiscriminant.fit(df, cols, "label"), bayes.QuadraticDiscriminant.fit(df, cols, "label", 0.01), linear.LogisticRegression.fit(df, cols, "label", 3, 60, alpha=0.001), linear.SVM.fit(df, cols, "label", 3, 60, 0.05), linear.SVM.fit(df, cols, "label", 3, 60, 0.05, optimizer="adam")]
    for m in fits:
        assert classification.accuracy(m.predict(df), "label", "prediction").first()[0] >= 0.96
    p = fits[3].predict_probability(df).select(X.total(F.col("probability"))).collect()
    assert all(abs(r[0] - 1) < 1e-9 for r in p)
    assert linear.hinge_loss(np.array([[4.0, 12.0]]), np.array([[1, 0]])) == 6.0


def test_clusterings_on_blobs(spark, blobs):
    x, y, df, cols = blobs

    def labels(out, c="label"):
        return [r[c] for r in out.orderBy("id").collect()]

    assert same_partition(labels(clustering.KMeans.fit(df, 3, num_runs=3).predict(df), "cluster"), y)
    assert same_partition(labels(clustering.GaussianMixture.fit(df, 3).predict(df)), y)
    assert same_partition(labels(clustering.DBSCAN.fit(df, 1.5, 4).where("label >= 0").join(df.select("id", F.col("label").alias("y")), "id")), [y[r.id] for r in clustering.DBSCAN.fit(df, 1.5, 4).where("label >= 0").orderBy("id").collect()])
    assert same_partition(labels(clustering.HDBSCAN.fit(df, 5)), y) or len(set(labels(clustering.HDBSCAN.fit(df, 5))) - {-1}) == 3
    assert len(set(labels(clustering.OPTICS.fit(df, 5, eps=2.0))) - {-1}) == 3
    assert same_partition(labels(clustering.SpectralClustering.fit(df, 3, gamma=0.5, num_runs=5)), y)
    for method in ("average", "complete", "single", "ward", "weighted"):
        tree = clustering.Hierarchical.fit(df, method)
        assert same_partition(tree.labels(num_clusters=3), y)
        assert (np.diff(tree.heights) >= 0).all() and tree.sizes[-1] == 60
    assert tree.labels(num_clusters=60).tolist() == list(range(60))
    assert sorted(itertools.chain(*tree.labels_map(num_clusters=3).values())) == list(range(60))
    ap = clustering.AffinityPropagation.fit(df, damping_factor=0.7).prune()
    assert same_partition(ap.labels, y)
    by = clustering.by_group(df, "label", "id", "features", lambda m: np.zeros(len(m), int))
    assert by.count() == 60


def test_kmeans_rejects_more_clusters_than_rows(spark, blobs):
    with pytest.raises(ValueError):
        clustering.KMeans.fit(blobs[2], 61)


def test_decompositions(spark, blobs):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4))
    df, cols = frame(spark, x)
    m = decomposition.PCA.fit(df, cols, 3)
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(m.singular_values, s[:3]) and np.allclose(np.abs(m.components @ v[:3].T), np.eye(3), atol=1e-8)
    z = np.array([r.pca for r in m.transform(df).orderBy("id").collect()])
    assert (z[np.abs(z).argmax(0), range(3)] > 0).all()
    white = np.array([r.pca for r in decomposition.PCA.fit_transform(df, cols, 3, True).collect()])
    assert np.allclose(np.cov(white.T), np.eye(3))
    parts = decomposition.PCA.incremental_fit([df.where("id < 20"), df.where("id >= 20")], cols, 3)
    assert np.allclose(parts.explained_variance, m.explained_variance)
    linear_k = np.array([r.kpca for r in decomposition.KernelPCA.fit_transform(df, "id", cols, 2).orderBy("id").collect()])
    assert np.allclose(np.abs(linear_k), np.abs(z[:, :2]), atol=1e-6)
    q = decomposition.randomized_range_finder(x, 4)
    assert np.allclose(q @ (q.T @ x), x)


# Curves.


def test_splines(spark):
    x = np.array([0.0, 1, 2.5, 3, 4.5, 6])
    cubic = x**3 - 2 * x
    t = spark.createDataFrame([(float(v),) for v in np.linspace(0, 6, 25)], "t double")
    got = interpolation.CubicSpline.from_points(x, cubic).predict(t, "t").orderBy("t").collect()
    assert np.allclose([r.y for r in got], [r.t**3 - 2 * r.t for r in got])  # a cubic is its own not-a-knot spline
    natural = interpolation.CubicSpline.from_points(x, cubic, "natural")
    assert abs(natural.coefficients[0, 1]) < 1e-12
    up = np.array([0.0, 1, 1, 4, 4.5, 9])
    y = [r.y for r in interpolation.MonotonicCubicSpline.from_points(x, up).predict(t, "t").orderBy("t").collect()]
    assert (np.diff(y) >= -1e-12).all()
    out = interpolation.LinearInterpolation.from_points(x, up).predict(spark.createDataFrame([(-1.0,), (7.0,)], "t double"), "t", left=-5.0, right=50.0).orderBy("t").collect()
    assert [r.y for r in out] == [-5.0, 50.0]
    assert math.isnan(interpolation.CubicSpline.from_points(x, up).predict(spark.createDataFrame([(9.0,)], "t double"), "t", extrapolate=False).first().y)
    line = interpolation.BezierSpline.from_points(x, 2 * x).predict(t, "t").collect()
    assert np.allclose([r.y for r in line], [2 * r.t for r in line], atol=1e-4)
    for bad in (lambda: interpolation.CubicSpline.from_points(x[:2], up[:2]), lambda: interpolation.BezierSpline.from_points(x[:2], up[:2]), lambda: interpolation.CubicSpline.from_points(x, up, "clamped")):
        with pytest.raises(ValueError):
            bad()


def test_simpson_is_exact_for_parabolas(spark):
    x = np.array([0.0, 0.5, 2, 3, 3.5, 5])
    for n in (5, 6):
        df = spark.createDataFrame([(float(a), float(a * a)) for a in x[:n]], "x double, y double")
        true = x[n - 1] ** 3 / 3
        got = {e: integrate.simpson(df, "x", "y", e).first()[0] for e in ("avg", "first", "last")}
        if n == 5:
            assert all(abs(v - true) < 1e-9 for v in got.values())
        assert abs(got["avg"] - (got["first"] + got["last"]) / 2) < 1e-9


def test_areas_without_groups(spark):
    rng = np.random.default_rng(16)
    x, y = np.round(rng.uniform(0, 9, 700), 2), rng.normal(size=700)
    order = np.lexsort((y, x))
    true = float((np.diff(x[order]) * (y[order][1:] + y[order][:-1]) / 2).sum())
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(9)
    assert abs(integrate.trapezoidal(df, "x", "y").first()[0] - true) < 1e-9
    assert abs(classification.auc(df, "x", "y").first()[0] - true) < 1e-9
    assert integrate.trapezoidal(df.limit(1), "x", "y").first()[0] == 0 and integrate.trapezoidal(df.limit(0), "x", "y").first()[0] == 0
    assert classification.auc(df.limit(1), "x", "y").first()[0] is None
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    assert abs(integrate.trapezoidal(df, "x", "y").first()[0] - true) < 1e-9
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_descent_from_a_ring(spark):
    rng = np.random.default_rng(18)
    df, _ = frame(spark, rng.normal(size=(200, 3)))
    true = neighbors.BruteKNN.fit(df, 5, exclude_self=True).predict(df)
    got = neighbors.NNDescent.fit(df, 5, max_candidates=20, max_iterations=12, tree_init=False)
    assert neighbors.neighbors_recall(true, got.graph).first()[0] >= 0.9


def test_optimisers():
    rosen = lambda z: (1 - z[0]) ** 2 + 100 * (z[1] - z[0] ** 2) ** 2
    for out in (optimize.BFGS.minimize(np.array([-1.0, 2.0]), rosen), optimize.NelderMead.minimize(np.array([-1.0, 2.0]), rosen, 1e-8, 2000)):
        assert out.converged and np.allclose(out.x, [1, 1], atol=1e-3)
    for m in (optimize.Brent, optimize.GoldenSection):
        out = m.minimize(-2.0, 9.0, lambda v: 2 * (v - 1.75) ** 2 + 1)
        assert out.converged and abs(out.x - 1.75) < 1e-4
    assert optimize.Brent.minimize(-2.0, 9.0, lambda v: 2 * (v - 1.75) ** 2 + 1).fun_evals < 12


def test_folds(spark):
    df = spark.range(11).withColumn("w", F.lit(1.0))
    parts = list(model_selection.k_fold_split(df, 3, "id"))
    assert [sorted(r.id for r in t.collect()) for _, t in parts] == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    assert all(a.count() == 6 for a, _ in parts)
    out = model_selection.weighted_grid_search(df, ["w"], lambda t: model_selection.k_fold_split(t, 2, "id"), lambda a, b, w, o: [a.count() * o["k"]], {"k": [1, 2]})
    assert [(o["k"], s.tolist()) for o, s in out] == [(1, [5.0]), (2, [10.0])]
    assert model_selection.weighted_cross_validate(df, "w", lambda t: model_selection.k_fold_split(t, 2, "id"), lambda a, b, w: [b.count(), 1.0]).tolist() == [[5, 5], [1, 1]]


def test_manifolds(blobs):
    x, y, df, cols = blobs

    def apart(z):
        c = np.array([z[y == k].mean(0) for k in range(3)])
        inner = max(np.linalg.norm(z[y == k] - c[k], axis=1).mean() for k in range(3))
        return min(np.linalg.norm(c[a] - c[b]) for a, b in ((0, 1), (0, 2), (1, 2))) > 2 * inner

    assert apart(manifold.tsne(x, perplexity=10, learning_rate=50, num_iters=300))
    out, stress = manifold.MDS.fit(df, n_init=2)
    assert apart(np.array([r.embedding for r in out.orderBy("id").collect()])) and stress < 1
    assert apart(manifold.trimap(x, num_iters=200))
    z, w = np.zeros((3, 2)), np.ones(1)
    assert manifold.trimap_loss(z, np.array([[0, 1, 2]]), w) == 0.5
