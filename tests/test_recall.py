"""Registered approximate searches against exact search over the whole table, at two sizes."""

import numpy as np
import pytest

from latticework.operators import neighbors
from latticework.plans import queries as plans


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", ["random_projection_forest", "large_vis", "nn_descent"])
def test_registered_recall(spark, name, size):
    d = f"/root/testdata/{size}"
    e = plans.embeddings(spark, d)
    got = plans.QUERIES[name](spark, d).cache()
    own = got.where("query_id = neighbor_id").count() > 0
    true = neighbors.BruteKNN.fit(e, 5, exclude_self=not own).predict(e).where("query_id <> neighbor_id")
    recall = neighbors.neighbors_recall(true, got).first()[0]
    assert recall >= 0.9
    assert got.count() == 5 * e.count()


@pytest.mark.parametrize("skip", [False, True])
def test_nearest_of_a_leaf_is_exact(skip):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, size=(300, 3)).astype(float)  # many equal points and distances
    ids = rng.permutation(300)
    a, b, d = neighbors.nearest(ids, x, ids, x, 4, skip)
    for i, v in zip(ids, x):
        want = sorted((float(np.sqrt(((v - w) ** 2).sum())), int(j)) for j, w in zip(ids, x) if not (skip and i == j))[:4]
        assert [(float(p), int(j)) for p, j in zip(d[a == i], b[a == i])] == want


def test_vectors_are_exchanged_as_they_are(spark):
    """Single precision isn't widened on its way to a leaf or a pair, and distances are those of doubles."""
    d = "/root/testdata/sf0.001"
    one, two = plans.single(spark, d), plans.embeddings(spark, d)
    forests = [neighbors.RandomProjectionForest.fit(e, 5, 4, 20) for e in (one, two)]
    assert dict(forests[0]._in_leaves(one, True, True).dtypes)["x"] == "array<float>"
    near = [sorted(map(tuple, f.predict(e, True).collect())) for f, e in zip(forests, (one, two))]
    assert near[0] == near[1]
    pairs = two.select(two.id.alias("query_id"), (two.id + 1).alias("neighbor_id"))
    among = [sorted(map(tuple, neighbors.search_among(e, e, pairs, 3).collect())) for e in (one, two)]
    assert among[0] == among[1] and among[0]
