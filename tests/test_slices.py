"""Methods on all pairs by slices: they keep no n x n matrix, so the limit of the dense ones doesn't hold for them."""

import numpy as np
import pytest

from latticework.operators import clustering, decomposition, manifold, neighbors
from latticework.operators.slices import largest


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.4, (30, 3)) for c in (0, 2, 5)])
    x[7] = x[3]  # equal rows
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")


def of(df, column="label"):
    return [r[column] for r in df.orderBy("id").collect()]


def partition(labels):
    return sorted(sorted(np.flatnonzero(np.array(labels) == k).tolist()) for k in set(labels))


def test_largest_eigenvectors():
    a = np.random.default_rng(0).standard_normal((200, 200))
    a = a + a.T
    values, v = np.linalg.eigh(a)
    got, u = largest(lambda z: a @ z, 200, 3)
    assert np.allclose(got, values[::-1][:3])
    assert np.allclose(np.abs((u * v[:, ::-1][:, :3]).sum(0)), 1)


@pytest.fixture
def no_dense(monkeypatch):
    monkeypatch.setattr(clustering, "DENSE_LIMIT", 10)


def test_spectral_clustering_without_a_dense_matrix(spark, cloud, no_dense):
    want = clustering.spectral_embedding(np.exp(-clustering._sq(cloud, cloud)), 3)
    kept = {}
    fit = clustering.KMeans.fit
    clustering.KMeans.fit = staticmethod(lambda rows, *a, **o: kept.update(u=np.array(of(rows, "features"))) or fit(rows, *a, **o))
    try:
        labels = of(clustering.SpectralClustering.fit(frame(spark, cloud), 3))
    finally:
        clustering.KMeans.fit = staticmethod(fit)
    assert np.allclose(kept["u"], want, atol=1e-7)
    assert len(set(labels)) == 3


def test_single_linkage_without_a_dense_matrix(spark, cloud, no_dense, monkeypatch):
    monkeypatch.setattr("latticework.operators.slices.TREE_ROWS", 20)
    want, got = clustering.linkage(clustering.distances(cloud, cloud), "single"), clustering.Hierarchical.fit(frame(spark, cloud), "single")
    assert np.allclose(got.heights, want.heights)
    for height in (0.3, 0.5, 1.0):
        assert got.labels(height=height).tolist() == want.labels(height=height).tolist()
        assert list(got.labels_map(height=height).values()) == list(want.labels_map(height=height).values())


def test_ward_without_a_dense_matrix(spark, cloud, no_dense):
    want, got = clustering.linkage(clustering.distances(cloud, cloud), "ward"), clustering.Hierarchical.fit(frame(spark, cloud), "ward")
    assert np.allclose(got.heights, want.heights)
    assert got.clades.tolist() == want.clades.tolist()
    assert got.sizes.tolist() == want.sizes.tolist()


def test_hdbscan_without_a_dense_matrix(spark, cloud, no_dense, monkeypatch):
    monkeypatch.setattr("latticework.operators.slices.TREE_ROWS", 20)
    assert partition(of(clustering.HDBSCAN.fit(frame(spark, cloud), 5))) == partition(clustering.hdbscan_labels(cloud, 5).tolist())


def test_optics_without_a_dense_matrix(spark, cloud, no_dense):
    assert of(clustering.OPTICS.fit(frame(spark, cloud), 5, eps=0.5)) == clustering.optics_labels(cloud, 5, eps=0.5).tolist()
    assert of(clustering.OPTICS.fit(frame(spark, cloud), 5, eps=0.5, metric="manhattan")) == clustering.optics_labels(cloud, 5, eps=0.5, metric="manhattan").tolist()


def test_kernel_pca_of_more_rows_than_a_matrix_had(spark):
    x = np.random.default_rng(5).normal(size=(5200, 3)) * [3, 2, 1]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    got = np.array(of(decomposition.KernelPCA.fit_transform(df, "id", ["a", "b", "c"], 2), "kpca"))
    c = x - x.mean(0)
    z = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(got), np.abs(z), atol=1e-6)


def test_kernel_pca_of_an_rbf_kernel(spark, cloud):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(cloud)], "id long, a double, b double, c double")
    got = np.array(of(decomposition.KernelPCA.fit_transform(df, "id", ["a", "b", "c"], 2, kernel="rbf"), "kpca"))
    k = decomposition.kernel_matrix(cloud, cloud, "rbf", 1 / 3, 3, 1.0)
    values, v = np.linalg.eigh(k - k.mean(0) - k.mean(1)[:, None] + k.mean())
    assert np.allclose(np.abs(got), np.abs(v[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])), atol=1e-7)


@pytest.fixture
def no_manifold(monkeypatch, no_dense):
    monkeypatch.setattr(manifold, "MANIFOLD_LIMIT", 10)


@pytest.mark.parametrize("normalized", [False, True])
def test_mds_without_a_dense_matrix(spark, cloud, no_manifold, normalized):
    starts = [np.random.default_rng(r).uniform(size=(len(cloud), 2)) for r in range(3)]
    runs = [manifold.smacof(manifold.distances(cloud, cloud), s, normalized=normalized, max_iter=40) for s in starts]
    y, stress, _ = min(runs, key=lambda r: r[1])
    got, found = manifold.MDS.fit(frame(spark, cloud), n_init=3, normalized_stress=normalized, max_iter=40)
    assert np.isclose(found, stress) and np.allclose(np.array(of(got, "embedding")), y, atol=1e-6)


@pytest.mark.parametrize("metric", ["squared_euclidean", "manhattan"])
def test_tsne_without_a_dense_matrix(spark, cloud, no_manifold, metric):
    want = manifold.tsne(cloud, perplexity=10, learning_rate=20, num_iters=5, metric=metric)
    got = manifold.TSNE.fit(frame(spark, cloud), perplexity=10, learning_rate=20, num_iters=5, metric=metric)
    assert np.allclose(np.array(of(got, "embedding")), want, rtol=1e-5, atol=1e-9)


def test_trimap_without_a_dense_matrix(spark, cloud, no_manifold):
    got = np.array(of(manifold.Trimap.transform(frame(spark, cloud), num_iters=200), "embedding"))
    assert np.allclose(got, manifold.trimap(cloud, num_iters=200))


def test_triplets():
    x = np.random.default_rng(1).normal(size=(40, 3))
    t, w = manifold.make_triplets(x, 4, 3, 2, 0.5, "euclidean", np.random.default_rng(0))
    d = manifold.distances(x, x)
    order = np.argsort(d, axis=1)
    assert len(t) == 40 * (4 * 3 + 2) and (w >= 0).all()
    for i, j, k in t[: 40 * 12]:
        assert j in order[i, 1:5] and k not in order[i, :5]
    assert all(len({i, j, k}) == 3 and d[i, j] <= d[i, k] for i, j, k in t[40 * 12 :])


def test_kd_tree_looks_at_small_subtrees_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    x, q = rng.integers(0, 6, (3000, 4)).astype(float), rng.uniform(0, 6, (300, 4))
    order = neighbors.KDTree.permutation(x)
    tree = neighbors.KDTree(order, x[order], 4)
    calls = []
    measure = neighbors.distances
    monkeypatch.setattr(neighbors, "distances", lambda a, b, m: calls.append(len(b)) or measure(a, b, m))
    d, found = tree.search_many(q)
    assert max(calls) > 100  # a node at a time before
    true = measure(q, x)
    for r in range(len(q)):
        assert list(zip(d[r].tolist(), found[r].tolist())) == sorted(zip(true[r].tolist(), range(3000)))[:4]


@pytest.mark.parametrize("block", [20, 2048])
def test_pairs_within_a_radius_are_counted_in_blocks(spark, cloud, monkeypatch, block):
    monkeypatch.setattr(neighbors, "WIDE", block)
    df = spark.createDataFrame([(i, r.tolist(), None if i % 11 == 0 else i % 4) for i, r in enumerate(cloud)], "id long, features array<double>, label int")
    near = neighbors.distances(cloud, cloud) <= 0.6
    np.fill_diagonal(near, False)
    want = {}
    for i in range(len(cloud)):
        for j in np.flatnonzero(near[i]).tolist():
            key = i, None if j % 11 == 0 else j % 4
            want[key] = want.get(key, 0) + 1
    rows = neighbors.radius_sums(df, df, 0.6, "label", exclude_self=True).collect()
    assert {(r.query_id, r.value): r.w for r in rows} == want


def test_silhouettes_and_dbscan_by_wide_blocks(spark, cloud, monkeypatch):
    """No task takes all distances of its block at once, and several blocks give what one gives."""
    df = spark.createDataFrame([(i, r.tolist(), i // 30) for i, r in enumerate(cloud)], "id long, features array<double>, label int")
    d, y = clustering.distances(cloud, cloud), np.arange(len(cloud)) // 30
    mean = np.stack([(d[:, y == k].sum(1) / (np.sum(y == k) - (y == k))) for k in range(3)], 1)
    a = mean[np.arange(len(y)), y]
    mean[np.arange(len(y)), y] = np.inf
    b = mean.min(1)
    seen = []
    join = neighbors._block_join
    monkeypatch.setattr(neighbors, "_block_join", lambda *r, **o: seen.append(r[7] if len(r) > 7 else o.get("block")) or join(*r, **o))
    one = of(clustering.DBSCAN.fit(df, 0.6, 4))
    monkeypatch.setattr(neighbors, "WIDE", 20)
    monkeypatch.setattr(neighbors, "CHUNK", 8)
    assert np.allclose(of(clustering.silhouette_samples(df, "label"), "silhouette"), (b - a) / np.maximum(a, b))
    assert of(clustering.DBSCAN.fit(df, 0.6, 4)) == one
    assert seen == [16384, 20, 20]


def messages(x, rounds, damping, pref, converge_after):
    """Affinity propagation on whole matrices: (rounds, exemplars, labels)."""
    n, rows = len(x), np.arange(len(x))
    s = -clustering._sq(x, x)
    off = s[~np.eye(n, dtype=bool)]
    np.fill_diagonal(s, pref(off) if callable(pref) else pref)
    s = s + (np.finfo(float).eps * s + np.finfo(float).tiny * 100) * np.random.default_rng(0).standard_normal((n, n))
    r, a, same, last = np.zeros((n, n)), np.zeros((n, n)), 0, None
    for k in range(1, rounds + 1):
        t = a + s
        top = t.argmax(1)
        first = t[rows, top]
        t[rows, top] = -np.inf
        new = s - first[:, None]
        new[rows, top] = s[rows, top] - t.max(1)
        r = damping * r + (1 - damping) * new
        pos = np.maximum(r, 0)
        np.fill_diagonal(pos, np.diag(r))
        new = pos.sum(0)[None, :] - pos
        own = np.diag(new).copy()
        new = np.minimum(new, 0)
        np.fill_diagonal(new, own)
        a = damping * a + (1 - damping) * new
        now = np.diag(a) + np.diag(r) > 0
        same = same + 1 if last is not None and (now == last).all() else 0
        last = now
        if same >= converge_after and now.any():
            break
    ex = np.flatnonzero(last)
    labels = s[:, ex].argmax(1)
    labels[ex] = np.arange(len(ex))
    return k, ex.tolist(), labels.tolist()


@pytest.mark.parametrize("preference", ["reduce_min", "reduce_max", "reduce_mean", "reduce_median", -4.0])
def test_affinity_propagation_without_a_dense_matrix(spark, cloud, no_dense, monkeypatch, preference):
    monkeypatch.setattr(clustering, "CELLS", 400)  # several chunks a task
    pref = {"reduce_min": np.min, "reduce_max": np.max, "reduce_mean": np.mean, "reduce_median": np.median}.get(preference, preference)
    df = frame(spark, cloud)
    m = clustering.AffinityPropagation.fit(df, damping_factor=0.7, preference=preference)
    assert (m.iterations, m.exemplars.tolist(), m.labels.tolist()) == messages(cloud, 300, 0.7, pref, 15)
    d = clustering._sq(cloud, m.centers)
    assert of(m.predict(df)) == d.argmin(1).tolist()


def test_affinity_propagation_of_one_row(spark):
    m = clustering.AffinityPropagation.fit(frame(spark, np.ones((1, 2))))
    assert m.labels.tolist() == [0] and of(m.prune().predict(frame(spark, np.ones((1, 2))))) == [0]


@pytest.mark.parametrize("metric", ["manhattan", "squared_euclidean", "cosine", "euclidean"])
def test_pairwise_of_copies_makes_small_files(spark, tmp_path, monkeypatch, metric):
    monkeypatch.setattr(neighbors, "BLOCK", 300)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(100, 3)), 9, axis=0)[rng.permutation(900)]
    out = neighbors.pairwise(frame(spark, x), frame(spark, x), metric, digits=6)
    out.write.parquet(f"{tmp_path}/out")
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 2 * len(x) ** 2  # some 8 bytes a row before
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("query_id", "neighbor_id").toArrow()
    assert (rows["query_id"].to_numpy() == np.repeat(np.arange(900), 900)).all() and (rows["neighbor_id"].to_numpy() == np.tile(np.arange(900), 900)).all()
    assert np.allclose(rows["distance"].to_numpy(), neighbors.distances(x, x, metric).ravel(), rtol=0, atol=5.1e-7)


def test_half_up_is_the_round_of_spark(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=500) * 10 ** rng.uniform(-8, 12, 500), np.arange(-40, 40) * 5e-7, np.round(rng.uniform(0, 60, 2000), 7), [0.0, -0.0, 1e300, np.inf, np.nan]])
    want = spark.createDataFrame([(i, float(a)) for i, a in enumerate(v)], "i long, v double").selectExpr("i", "round(v, 6) + 0.0D r").orderBy("i").toArrow()["r"].to_numpy()
    got = neighbors.half_up(v, 6)
    assert np.array_equal(got, want, equal_nan=True) and not np.signbit(got[got == 0]).any()


def test_pairs_of_slices_get_tasks_of_their_own(spark, cloud, monkeypatch):
    """However few bytes they are, not one task for all."""
    monkeypatch.setattr(neighbors, "BLOCK", 20)
    tasks = neighbors.pairwise(frame(spark, cloud), frame(spark, cloud)).rdd.getNumPartitions()
    assert tasks >= 16  # 4 at most before, as many as shuffle partitions
