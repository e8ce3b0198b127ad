"""What the registered queries hand to their operators."""

import pytest
from pyspark.sql import functions as F

from latticework.operators import clustering, decomposition, linear, manifold
from latticework.plans import queries as plans

FITS = {
    "logistic_regression": (linear.LogisticRegression, "fit"), "svm": (linear.SVM, "fit"), "kernel_pca": (decomposition.KernelPCA, "fit_transform"), "gaussian_mixture": (clustering.GaussianMixture, "fit"),
    "optics": (clustering.OPTICS, "fit"), "hdbscan": (clustering.HDBSCAN, "fit"), "hierarchical": (clustering.Hierarchical, "fit"), "spectral_clustering": (clustering.SpectralClustering, "fit"),
    "affinity_propagation": (clustering.AffinityPropagation, "fit"), "tsne": (manifold.TSNE, "fit"), "mds": (manifold.MDS, "fit"), "trimap": (manifold.Trimap, "transform"),
}


class Seen(Exception):
    pass


def handed(monkeypatch, spark, sf, name):
    """Arguments of the first fit of a query."""

    def stop(*args, **opts):
        raise Seen(args, opts)

    monkeypatch.setattr(*FITS[name], stop)
    with pytest.raises(Seen) as seen:
        plans.QUERIES[name](spark, sf)
    return seen.value.args


@pytest.mark.parametrize("name", FITS)
def test_whole_vectors(monkeypatch, spark, sf, name):
    (df, *more), _ = handed(monkeypatch, spark, sf, name)
    cols = next((a for a in more if isinstance(a, list)), None)
    x = F.array(*cols) if cols else F.col("features")
    got = df.select("id", F.transform(x, lambda v: v.cast("double")).alias("x"))
    want = plans.embeddings(spark, sf).select("id", F.col("features").alias("x"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["logistic_regression", "svm", "gaussian_mixture", "affinity_propagation", "tsne", "mds", "trimap", "spectral_clustering"])
def test_default_rounds(monkeypatch, spark, sf, name):
    _, opts = handed(monkeypatch, spark, sf, name)
    assert not {"max_iterations", "iterations", "max_iter", "num_iters", "num_runs", "n_init", "tol", "eps"} & set(opts)


def test_pairwise_has_all_pairs(spark, sf):
    n = plans.embeddings(spark, sf).count()
    assert plans.QUERIES["pairwise_euclidean"](spark, sf).count() == n * n
