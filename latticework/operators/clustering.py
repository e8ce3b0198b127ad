"""Clustering. K-means and mixtures keep their rows distributed and aggregate sums an iteration; DBSCAN is a
neighbour join and connected components. Single and Ward's linkage, OPTICS, HDBSCAN and spectral clustering need
all pairs or a sequential order: the driver holds n x p numbers, all pairs go by slices of rows. Affinity propagation
keeps its messages in files of the tasks. Other linkages keep an n x n matrix of at most DENSE_LIMIT rows. All run on
many groups side by side through ``by_group``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import validation as V
from ..functions import vectors
from ..functions.lineage import checkpointed
from ..functions.sums import total
from .neighbors import _matrix, distances, radius_neighbors
from .slices import CELLS, Kept, Slices, largest, squares

DENSE_LIMIT = 20_000


def dense(df: DataFrame, id: str, features: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a bounded frame, by rising id, for methods that need an n x n matrix."""
    n = df.count()
    if n > DENSE_LIMIT:
        raise ValueError(f"{n} rows are over the {DENSE_LIMIT} that this method takes; run it by_group")
    return matrix(df, id, features)


def matrix(df: DataFrame, id: str, features: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix (n x p, no more) of a frame, by rising id."""
    rows = df.select(F.col(id).alias("id"), vectors.doubles(features).alias("x")).orderBy("id").toArrow()
    return rows["id"].to_numpy(), _matrix(rows["x"])


def labelled(df: DataFrame, ids: np.ndarray, labels: np.ndarray) -> DataFrame:
    return df.sparkSession.createDataFrame(pa.table({"id": ids, "label": labels.astype(np.int32)}))


def by_group(df: DataFrame, group: str, id: str, features: str, label: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(group, id, cluster): ``label`` of the matrix of each group, a group a task."""
    kind = df.schema[group].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        own = own.sort_by("id")
        return pa.table({group: pa.array([key[0].as_py()] * own.num_rows, own[group].type), "id": own["id"], "cluster": pa.array(label(_matrix(own["x"])).astype(np.int32))})

    return df.select(group, F.col(id).cast("long").alias("id"), vectors.doubles(features).alias("x")).groupBy(group).applyInArrow(run, f"`{group}` {kind}, id long, cluster int")


# K-means.


@dataclass(frozen=True)
class KMeansModel:
    centroids: np.ndarray
    inertia: float
    iterations: int
    features: str = "features"

    def _distances(self) -> Column:
        x = vectors.doubles(self.features)
        return F.array(*[vectors.squared_euclidean(x, F.array(*[F.lit(float(v)) for v in c])) for c in self.centroids])

    def predict(self, df: DataFrame, output: str = "cluster") -> DataFrame:
        """The nearest centroid, the first of equally near ones."""
        return df.withColumn(output, vectors.argmin_index(self._distances()))

    def transform(self, df: DataFrame, output: str = "distances") -> DataFrame:
        return df.withColumn(output, F.transform(self._distances(), F.sqrt))


def _sums(table: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``part(x, w)`` over the Arrow batches of a table that is kept."""
    return total(table, lambda b: part(_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)), table.rdd.getNumPartitions())


def _sq(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c, "squared_euclidean")


class KMeans:
    @staticmethod
    def fit(df: DataFrame, num_clusters: int, features: str = "features", id: str = "id", max_iterations: int = 300, num_runs: int = 10, tol: float = 1e-4, weight: str | None = None, init: str | np.ndarray = "k_means_plus_plus", seed: int = 0) -> KMeansModel:
        """Lloyd's iterations of all runs together, one pass each; a run stops by itself, an empty cluster keeps its centroid.

        ``init``: "k_means_plus_plus", "random", or centroids. The first two draw from a bounded sample.
        """
        k = V.positive_integer(num_clusters)
        table = df.select(vectors.doubles(features).alias("x"), V.weight_column(weight).alias("w")).cache()
        try:
            n, mean_var = table.count(), 0.0
            first = _sums(table, lambda x, w: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
            p = (len(first) - 1) // 2
            mean_var = float(np.mean(first[1 + p :] / n - (first[1 : 1 + p] / n) ** 2))
            if k > n:
                raise ValueError(f"{k} clusters of {n} rows")
            if isinstance(init, np.ndarray):
                starts = [init.astype(float)]
            else:
                V.one_of(init, ("k_means_plus_plus", "random"))
                sample = _matrix(df.select(vectors.doubles(features).alias("x")).orderBy(F.xxhash64(id, F.lit(seed)), id).limit(min(n, 20_000)).toArrow()["x"])
                starts = [KMeans._start(sample, k, init, np.random.default_rng(seed + r)) for r in range(num_runs)]
            c = np.stack(starts)
            live, rounds = np.ones(len(c), bool), 0
            inertia = np.full(len(c), np.inf)
            for rounds in range(1, max_iterations + 1):
                at = np.flatnonzero(live)
                sent = c[at]

                def part(x: np.ndarray, w: np.ndarray, sent: np.ndarray = sent) -> np.ndarray:
                    out = np.zeros((len(sent), k, p + 2))
                    for r, own in enumerate(sent):
                        d = _sq(x, own)
                        near = d.argmin(1)
                        np.add.at(out[r, :, :p], near, x * w[:, None])
                        np.add.at(out[r, :, p], near, w)
                        np.add.at(out[r, :, p + 1], near, w * d[np.arange(len(x)), near])
                    return out

                s = _sums(table, part).reshape(len(at), k, p + 2)
                new = np.where(s[:, :, p : p + 1] > 0, s[:, :, :p] / np.maximum(s[:, :, p : p + 1], 1e-300), sent)
                inertia[at] = s[:, :, p + 1].sum(1)
                moved = ((new - sent) ** 2).sum((1, 2))
                c[at] = new
                live[at] = moved > tol * mean_var
                if not live.any():
                    break
            best = int(inertia.argmin())
            return KMeansModel(c[best], float(inertia[best]), rounds, features)
        finally:
            table.unpersist()

    @staticmethod
    def _start(x: np.ndarray, k: int, init: str, rng: np.random.Generator) -> np.ndarray:
        if init == "random":
            return x[rng.choice(len(x), k, replace=False)].copy()
        c = [x[rng.integers(len(x))]]
        d = _sq(x, np.array(c))[:, 0]
        for _ in range(k - 1):
            c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
            d = np.minimum(d, _sq(x, c[-1][None, :])[:, 0])
        return np.array(c)


# Gaussian mixtures.


@dataclass(frozen=True)
class GaussianMixtureModel:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float
    iterations: int
    features: str = "features"

    def _log_joint(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.weights)))
        for k in range(len(self.weights)):
            low = np.linalg.cholesky(self.covariances[k])
            z = np.linalg.solve(low, (x - self.means[k]).T)
            out[:, k] = np.log(self.weights[k]) - 0.5 * (z * z).sum(0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out

    def predict_prob(self, df: DataFrame, id: str = "id") -> DataFrame:
        """(id, label, probability: array)."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    j = sent.value._log_joint(_matrix(b.column(1)))
                    e = np.exp(j - j.max(1, keepdims=True))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(j.argmax(1).astype(np.int32)), pa.array((e / e.sum(1, keepdims=True)).tolist(), pa.list_(pa.float64()))], ["id", "label", "probability"])

        return df.select(F.col(id).cast("long").alias("id"), vectors.doubles(self.features).alias("x")).mapInArrow(run, "id long, label int, probability array<double>")

    def predict(self, df: DataFrame, id: str = "id") -> DataFrame:
        return self.predict_prob(df, id).select("id", "label")


class GaussianMixture:
    @staticmethod
    def fit(df: DataFrame, num_gaussians: int, features: str = "features", id: str = "id", num_runs: int = 1, max_iter: int = 100, tol: float = 1e-3, eps: float = 1e-6, seed: int = 0) -> GaussianMixtureModel:
        """Expectation maximisation from k-means, one pass an iteration; runs differ in their seed."""
        k, best = V.positive_integer(num_gaussians), None
        table = df.select(vectors.doubles(features).alias("x"), F.lit(1.0).alias("w")).cache()
        try:
            for r in range(num_runs):
                start = KMeans.fit(df, k, features, id, num_runs=1, seed=seed + r)
                p = start.centroids.shape[1]
                reg = eps * np.eye(p)

                def moments(resp: Callable[[np.ndarray], tuple[np.ndarray, float]]) -> tuple[np.ndarray, float]:
                    def part(x: np.ndarray, w: np.ndarray) -> np.ndarray:
                        z, ll = resp(x)
                        return np.concatenate([[ll, len(x)], z.sum(0), (z.T @ x).ravel(), np.einsum("nk,ni,nj->kij", z, x, x).ravel()])

                    return _sums(table, part)

                def solve(s: np.ndarray) -> GaussianMixtureModel:
                    nk = s[2 : 2 + k] + 10 * np.finfo(float).eps
                    m = s[2 + k : 2 + k + k * p].reshape(k, p) / nk[:, None]
                    c = s[2 + k + k * p :].reshape(k, p, p) / nk[:, None, None] - np.einsum("ki,kj->kij", m, m) + reg
                    return GaussianMixtureModel(nk / nk.sum(), m, c, float(s[0] / s[1]), 0, features)

                centers = start.centroids

                def hard(x: np.ndarray, centers: np.ndarray = centers) -> tuple[np.ndarray, float]:
                    return np.eye(k)[_sq(x, centers).argmin(1)], 0.0

                model, last = solve(moments(hard)), -np.inf
                for i in range(1, max_iter + 1):

                    def soft(x: np.ndarray, model: GaussianMixtureModel = model) -> tuple[np.ndarray, float]:
                        j = model._log_joint(x)
                        top = j.max(1, keepdims=True)
                        e = np.exp(j - top)
                        total = e.sum(1, keepdims=True)
                        return e / total, float((top + np.log(total)).sum())

                    s = moments(soft)
                    new = solve(s)
                    model = GaussianMixtureModel(new.weights, new.means, new.covariances, float(s[0] / s[1]), i, features)
                    if abs(model.log_likelihood - last) < tol:
                        break
                    last = model.log_likelihood
                if best is None or model.log_likelihood > best.log_likelihood:
                    best = model
            return best
        finally:
            table.unpersist()


# DBSCAN.


def min_label_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component: smallest reachable id) of edges (a, b): least labels of neighbours, then labels of labels."""
    both = checkpointed(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    state = None
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "m").alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = checkpointed(new.join(jump, "component").select("node", F.col("further").alias("component")))
        now = labels.agg(F.sum(F.col("component").cast("decimal(20,0)"))).first()[0]
        if now == state:
            return labels
        state = now
    raise RuntimeError("components did not converge")


class DBSCAN:
    @staticmethod
    def fit(df: DataFrame, eps: float = 0.5, min_samples: int = 5, features: str = "features", id: str = "id", metric: object = "euclidean", weight: str | None = None) -> DataFrame:
        """(id, core, label): clusters from 0 by their smallest core id, noise -1; a border point goes to the first of its cores' clusters."""
        rows = df.select(F.col(id).cast("long").alias("id"), vectors.doubles(features).alias("x"), V.weight_column(weight).alias("w"))
        pairs = checkpointed(radius_neighbors(rows, rows, eps, "id", "x", metric, ["w"]))
        core = checkpointed(pairs.groupBy("query_id").agg(F.sum("w").alias("n")).where(F.col("n") >= min_samples).select(F.col("query_id").alias("id")))
        edges = pairs.join(core.withColumnRenamed("id", "query_id"), "query_id", "left_semi").join(core.withColumnRenamed("id", "neighbor_id"), "neighbor_id", "left_semi").select(F.col("query_id").alias("a"), F.col("neighbor_id").alias("b"))
        comps = min_label_components(edges)
        # As many rows as there are clusters.
        names = comps.select("component").distinct().select("component", (F.row_number().over(W.orderBy("component")) - 1).alias("label"))
        named = checkpointed(comps.join(names, "component").select(F.col("node").alias("id"), "label"))
        border = pairs.join(named.withColumnRenamed("id", "neighbor_id"), "neighbor_id").join(core.withColumnRenamed("id", "query_id"), "query_id", "left_anti").groupBy(F.col("query_id").alias("id")).agg(F.min("label").alias("label"))
        all_labels = named.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))
        return rows.select("id").join(all_labels, "id", "left").select("id", F.coalesce("core", F.lit(False)).alias("core"), F.coalesce("label", F.lit(-1)).alias("label"))


# Dense methods: kernels on a matrix, with wrappers on frames.


def optics_labels(x: np.ndarray, min_samples: int = 5, max_eps: float = np.inf, eps: float | None = None, metric: object = "euclidean") -> np.ndarray:
    n = len(x)
    core = np.sort(distances(x, x, metric), axis=1)[:, min_samples - 1] if n >= min_samples else np.full(n, np.inf)
    return _optics(x, core, max_eps, eps, lambda p: distances(x[p : p + 1], x, metric)[0])


def _optics(x: np.ndarray, core: np.ndarray, max_eps: float, eps: float | None, row: Callable[[int], np.ndarray]) -> np.ndarray:
    """The order takes one row of distances at a time."""
    n = len(x)
    core = np.where(core > max_eps, np.inf, core)
    reach, done, order = np.full(n, np.inf), np.zeros(n, bool), []
    for _ in range(n):
        left = np.flatnonzero(~done)
        p = left[np.argmin(reach[left])]
        done[p] = True
        order.append(p)
        if np.isfinite(core[p]):
            d = row(p)
            new = np.maximum(core[p], d)
            better = ~done & (d <= max_eps) & (new < reach)
            reach[better] = new[better]
    cut = max_eps if eps is None else eps
    order = np.array(order)
    far, near = reach[order] > cut, core[order] <= cut
    labels = np.empty(n, int)
    labels[order] = np.cumsum(far & near) - 1
    labels[order[far & ~near]] = -1
    return labels


class OPTICS:
    @staticmethod
    def fit(df: DataFrame, min_samples: int = 5, max_eps: float = np.inf, eps: float | None = None, features: str = "features", id: str = "id", metric: object = "euclidean") -> DataFrame:
        ids, x = matrix(df, id, features)
        n = len(x)
        if metric != "euclidean":
            with Slices(df.sparkSession, x) as rows:
                core = rows.each(lambda x, a, b: np.partition(distances(x[a:b], x, metric), min_samples - 1, axis=1)[:, min_samples - 1]) if n >= min_samples else np.full(n, np.inf)
            return labelled(df, ids, _optics(x, core, max_eps, eps, lambda p: distances(x[p : p + 1], x, metric)[0]))
        with Slices(df.sparkSession, x) as rows:
            core = rows.core(min_samples) if n >= min_samples else np.full(n, np.inf)
        norms = (x * x).sum(1)

        def row(p: int) -> np.ndarray:
            d = norms + norms[p] - 2 * (x @ x[p])
            near = np.flatnonzero(d < 1e-4 * (norms + norms[p]))
            d[near] = ((x[near] - x[p]) ** 2).sum(1)
            return np.sqrt(d)

        return labelled(df, ids, _optics(x, core, max_eps, eps, row))


@dataclass(frozen=True)
class Dendrogram:
    """Merges by rising height: ``clades`` (n + k is what merge k made), ``heights``, ``sizes``."""

    clades: np.ndarray
    heights: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def labels(self, num_clusters: int | None = None, height: float | None = None) -> np.ndarray:
        """Of a cut into ``num_clusters``, or below ``height``; numbered by first row."""
        n = len(self.clades) + 1
        if (num_clusters is None) == (height is None):
            raise ValueError("cut by num_clusters or by height")
        if num_clusters is not None and not 1 <= num_clusters <= n:
            raise ValueError(f"num_clusters must be in 1 .. {n}")
        cut = n - num_clusters if num_clusters is not None else int(np.searchsorted(self.heights, height, "left"))
        up = np.arange(2 * n - 1)
        for k in range(cut):
            up[self.clades[k]] = n + k
        root = np.arange(n)
        while (up[root] != root).any():
            root = up[root]
        _, first = np.unique(root, return_index=True)
        rank = {root[f]: r for r, f in enumerate(sorted(first))}
        return np.array([rank[r] for r in root])

    def labels_map(self, **cut) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for row, c in zip((self.ids if len(self.ids) else range(len(self.clades) + 1)), self.labels(**cut)):
            out.setdefault(int(c), []).append(int(row))
        return out

    def labels_list(self, **cut) -> list[int]:
        return self.labels(**cut).tolist()


_LINKAGES = ("average", "complete", "single", "ward", "weighted")


def linkage(d: np.ndarray, method: str = "single") -> Dendrogram:
    """Agglomeration of a distance matrix along chains of nearest neighbours."""
    V.one_of(method, _LINKAGES)
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    if not np.isfinite(d[~np.eye(n, dtype=bool)]).all():
        raise ValueError("distances must be finite")
    live, size = np.ones(n, bool), np.ones(n, int)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            a = chain[-1]
            b = int(np.argmin(np.where(live, d[a], np.inf)))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        h, na, nb = d[a, b], size[a], size[b]
        merges.append((h, a, b))
        rest = live.copy()
        rest[[a, b]] = False
        da, db, nk = d[a, rest], d[b, rest], size[rest]
        if method == "single":
            new = np.minimum(da, db)
        elif method == "complete":
            new = np.maximum(da, db)
        elif method == "average":
            new = (na * da + nb * db) / (na + nb)
        elif method == "weighted":
            new = (da + db) / 2
        else:
            new = np.sqrt(((na + nk) * da**2 + (nb + nk) * db**2 - nk * h**2) / (na + nb + nk))
        live[a] = False
        d[a, :] = d[:, a] = np.inf
        d[b, rest] = d[rest, b] = new
        size[b] = na + nb
    return _dendrogram(n, merges)


def _dendrogram(n: int, merges: list[tuple[float, int, int]]) -> Dendrogram:
    """Of merges (height, a row of one side, a row of the other)."""
    merges.sort(key=lambda m: m[0])
    up, clades, heights, sizes = {k: k for k in range(n)}, [], [], []
    name, count = list(range(n)), {k: 1 for k in range(n)}

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for k, (h, a, b) in enumerate(merges):
        ra, rb = find(a), find(b)
        pair = sorted((name[ra], name[rb]))
        up[ra] = rb
        name[rb] = n + k
        count[n + k] = count[pair[0]] + count[pair[1]]
        clades.append(pair)
        heights.append(h)
        sizes.append(count[n + k])
    return Dendrogram(np.array(clades, int).reshape(-1, 2), np.array(heights), np.array(sizes, int))


def single_linkage(spark: SparkSession, x: np.ndarray, core: np.ndarray | None = None) -> Dendrogram:
    """Single linkage of Euclidean distances (with ``core``, of mutual reachability): the merges are the edges of a minimal spanning tree."""
    with Slices(spark, x) as rows:
        a, b, h = rows.spanning_tree(core)
    return _dendrogram(len(x), list(zip(h.tolist(), a.tolist(), b.tolist())))


def ward_linkage(x: np.ndarray) -> Dendrogram:
    """Ward's linkage along chains of nearest neighbours, from centroids and sizes: n x p numbers, no matrix of distances."""
    n = len(x)
    c, size, name = x.astype(float), np.ones(n), np.arange(n)
    norms = (c * c).sum(1)
    live, merges, chain = np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if live.sum() * 2 < len(live):
            at = np.cumsum(live) - 1
            chain = [int(at[v]) for v in chain]
            c, size, name, norms = c[live], size[live], name[live], norms[live]
            live = np.ones(len(c), bool)
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            a = chain[-1]
            weight = 2 * size * size[a] / (size + size[a])
            d = np.where(live, weight * (norms + norms[a] - 2 * (c @ c[a])), np.inf)
            d[a] = np.inf
            # Products choose what may be the nearest; differences decide.
            near = np.flatnonzero(d <= d.min() + 1e-12 * weight.max() * (norms.max() + norms[a]))
            exact = weight[near] * ((c[near] - c[a]) ** 2).sum(1)
            h = exact.min()
            if len(chain) > 1 and (h == exact[near == chain[-2]]).any():
                b = chain[-2]
                break
            chain.append(int(near[exact.argmin()]))
        chain = chain[:-2]
        merges.append((float(np.sqrt(h)), int(name[a]), int(name[b])))
        c[b] = (size[a] * c[a] + size[b] * c[b]) / (size[a] + size[b])
        size[b] += size[a]
        norms[b] = c[b] @ c[b]
        live[a] = False
    return _dendrogram(n, merges)


class Hierarchical:
    @staticmethod
    def fit(df: DataFrame, linkage_method: str = "single", features: str = "features", id: str = "id", dissimilarity: str = "euclidean") -> Dendrogram:
        """``dissimilarity`` "precomputed": ``features`` holds a row's distances to all rows, by rising id.

        Single and Ward's linkage of Euclidean distances keep n x p numbers; the others an n x n matrix of at most DENSE_LIMIT rows.
        """
        V.one_of(dissimilarity, ("euclidean", "precomputed"))
        V.one_of(linkage_method, _LINKAGES)
        if dissimilarity == "euclidean" and linkage_method in ("single", "ward"):
            ids, x = matrix(df, id, features)
            out = single_linkage(df.sparkSession, x) if linkage_method == "single" else ward_linkage(x)
            return Dendrogram(out.clades, out.heights, out.sizes, ids)
        ids, x = dense(df, id, features)
        out = linkage(x if dissimilarity == "precomputed" else distances(x, x), linkage_method)
        return Dendrogram(out.clades, out.heights, out.sizes, ids)

    @staticmethod
    def frame(df: DataFrame, tree: Dendrogram) -> DataFrame:
        """(step, left, right, height, size)."""
        return df.sparkSession.createDataFrame(pa.table({"step": np.arange(len(tree.heights)), "left": tree.clades[:, 0], "right": tree.clades[:, 1], "height": tree.heights, "size": tree.sizes}))


def hdbscan_labels(x: np.ndarray, min_cluster_size: int = 5, min_samples: int | None = None, metric: object = "euclidean") -> np.ndarray:
    """Single linkage of mutual reachability, condensed to clusters of min_cluster_size, the most stable kept."""
    n, m = len(x), min_samples or min_cluster_size
    if n < max(2, min_cluster_size):
        return np.full(n, -1)
    d = distances(x, x, metric)
    core = np.sort(d, axis=1)[:, min(m, n) - 1]
    return condensed(linkage(np.maximum(d, np.maximum(core[:, None], core[None, :])), "single"), min_cluster_size)


def condensed(tree: Dendrogram, min_cluster_size: int) -> np.ndarray:
    """Labels of the most stable clusters of a hierarchy."""
    n = len(tree.clades) + 1
    kids = lambda v: tree.clades[v - n]
    size = lambda v: 1 if v < n else int(tree.sizes[v - n])
    rate = lambda v: 1 / tree.heights[v - n] if tree.heights[v - n] > 0 else np.inf

    def leaves(v: int) -> list[int]:
        out, todo = [], [v]
        while todo:
            u = todo.pop()
            if u < n:
                out.append(u)
            else:
                todo += kids(u).tolist()
        return out

    birth, parent, stability, points = [0.0], [-1], [0.0], [[]]
    todo = [(2 * n - 2, 0)]
    while todo:
        v, c = todo.pop()
        if v < n:
            continue
        lam = rate(v)
        gain = lambda k, lam=lam, c=c: (lam - birth[c]) * k if np.isfinite(lam) else 0.0
        a, b = kids(v).tolist()
        big = [u for u in (a, b) if size(u) >= min_cluster_size]
        if len(big) == 2:
            stability[c] += gain(size(v))
            for u in big:
                birth.append(lam)
                parent.append(c)
                stability.append(0.0)
                points.append([])
                todo.append((u, len(birth) - 1))
        else:
            for u in (a, b):
                if u in big:
                    todo.append((u, c))
                else:
                    stability[c] += gain(size(u))
                    points[c] += leaves(u)
    chosen, total = [c > 0 for c in range(len(birth))], list(stability)
    children: list[list[int]] = [[] for _ in birth]
    for c in range(1, len(birth)):
        children[parent[c]].append(c)
    for c in range(len(birth) - 1, 0, -1):
        below = children[c]
        inner = sum(total[k] for k in below)
        if below and inner > stability[c]:
            chosen[c], total[c] = False, inner
        else:
            todo = list(below)
            while todo:
                k = todo.pop()
                chosen[k] = False
                todo += children[k]
    labels, number = np.full(n, -1), {}
    for c in range(len(birth)):
        owner = c
        while owner >= 0 and not chosen[owner]:
            owner = parent[owner]
        if owner >= 0:
            for q in points[c]:
                labels[q] = owner
    for k, c in enumerate(dict.fromkeys(labels[labels >= 0].tolist())):
        number[c] = k
    return np.array([number.get(c, -1) for c in labels.tolist()])


class HDBSCAN:
    @staticmethod
    def fit(df: DataFrame, min_cluster_size: int = 5, min_samples: int | None = None, features: str = "features", id: str = "id", metric: object = "euclidean") -> DataFrame:
        n = df.count()
        if metric != "euclidean" or n < max(2, min_cluster_size):
            ids, x = dense(df, id, features)
            return labelled(df, ids, hdbscan_labels(x, min_cluster_size, min_samples, metric))
        ids, x = matrix(df, id, features)
        with Slices(df.sparkSession, x) as rows:
            core = rows.core(min(min_samples or min_cluster_size, n))
        return labelled(df, ids, condensed(single_linkage(df.sparkSession, x, core), min_cluster_size))


@dataclass(frozen=True)
class AffinityModel:
    ids: np.ndarray
    exemplars: np.ndarray  # rows
    centers: np.ndarray
    labels: np.ndarray
    iterations: int

    def prune(self) -> AffinityModel:
        """Without exemplars that no row has; labels renumbered."""
        used = np.unique(self.labels[self.labels >= 0])
        number = np.full(len(self.exemplars) + 1, -1)
        number[used] = np.arange(len(used))
        return AffinityModel(self.ids, self.exemplars[used], self.centers[used], np.where(self.labels >= 0, number[self.labels], -1), self.iterations)

    def predict(self, df: DataFrame, features: str = "features", output: str = "label") -> DataFrame:
        """The nearest exemplar, the first of equally near ones; by chunks, as there may be too many for an expression."""
        sent, step = df.sparkSession.sparkContext.broadcast(self.centers), max(1, CELLS // len(self.centers))
        out = StructType([*(f for f in df.schema.fields if f.name != output), StructField(output, IntegerType())])
        names = [f.name for f in out.fields[:-1]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = b.column(b.num_columns - 1)
                there, x = v.is_valid().to_numpy(zero_copy_only=False), _matrix(v.drop_null())
                labels = np.full(b.num_rows, -1, np.int32)
                if len(x):
                    labels[there] = np.concatenate([_sq(x[at : at + step], sent.value).argmin(1) for at in range(0, len(x), step)])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(labels, mask=~there)], [*names, output])

        return df.select(*[F.col(f"`{c}`") for c in names], vectors.doubles(features).alias("_x")).mapInArrow(run, out)


class AffinityPropagation:
    @staticmethod
    def fit(df: DataFrame, iterations: int = 300, damping_factor: float = 0.5, preference: str | float = "reduce_min", converge_after: int = 15, features: str = "features", id: str = "id", seed: int = 0) -> AffinityModel:
        """Messages between all pairs on negative squared distances, a slice of rows a task; ``preference``: a number, or reduce_min, reduce_max, reduce_mean, reduce_median of the similarities."""
        V.one_of(preference, tuple(REDUCED)) if isinstance(preference, str) else None
        ids, x = matrix(df, id, features)
        n = len(x)
        if n < 2:
            return AffinityModel(ids, np.arange(n), x, np.zeros(n, np.int64), 0)
        with Slices(df.sparkSession, x) as rows:
            parts = rows.together(lambda x, a, b, exchange: _messages(x, a, b, exchange, iterations, damping_factor, preference, converge_after, seed))
        k, count = parts[0][:2].astype(int)
        ex = parts[0][2 : 2 + count].astype(int)
        if not count:
            return AffinityModel(ids, ex, np.zeros((0, x.shape[1])), np.full(n, -1), k)
        labels = np.concatenate([p[2 + count :] for p in parts]).astype(int)
        labels[ex] = np.arange(count)
        return AffinityModel(ids, ex, x[ex], labels, k)


REDUCED = {"reduce_min": np.min, "reduce_max": np.max, "reduce_mean": np.sum, "reduce_median": None}


def _preference(kind: str, n: int, chunks: Callable[[], Iterator[np.ndarray]], exchange: Callable[[np.ndarray], list[np.ndarray]]) -> float:
    """Of the similarities of unlike rows; ``chunks`` gives this task's."""
    if kind != "reduce_median":
        v = REDUCED[kind](exchange(np.array([REDUCED[kind]([REDUCED[kind](c) for c in chunks()])])))
        return v / (n * (n - 1)) if kind == "reduce_mean" else v

    def at(rank: int) -> float:
        """By 16 bits a pass; similarities aren't positive, so their sizes are in the order of their bits."""
        prefix = 0
        for shift in (48, 32, 16, 0):
            counts = np.zeros(1 << 16)
            for c in chunks():
                bits = np.abs(c).view(np.uint64)
                counts += np.bincount((bits[bits >> np.uint64(shift) >> np.uint64(16) == prefix] >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            upto = np.cumsum(sum(exchange(counts)))
            digit = int(np.searchsorted(upto, rank, side="right"))
            rank -= int(upto[digit - 1]) if digit else 0
            prefix = prefix << 16 | digit
        return -float(np.uint64(prefix).view(np.float64))

    half = n * (n - 1) // 2
    return (at(half - 1) + at(half)) / 2


def _messages(x: np.ndarray, a: int, b: int, exchange: Callable[[np.ndarray], list[np.ndarray]], iterations: int, damping: float, preference: str | float, converge_after: int, seed: int) -> np.ndarray:
    """Affinity propagation, the rows a to b: rounds, number of exemplars, exemplars, and the labels of these rows.

    Similarities, responsibilities and availabilities of the rows are in files; a round goes through them by chunks. Tasks tell each
    other the sums of their columns and their part of the diagonal, so that all of them know the exemplars of a round.
    """
    n, step = len(x), max(1, CELLS // len(x))
    starts = range(a, b, step)
    sims, sent = Kept(), Kept()
    buffers = np.empty((4, step * n))

    def place(i: int) -> tuple[int, int, list[np.ndarray]]:
        c = min(step, b - i)
        return c, (i - a) * n, [v[: c * n].reshape(c, n) for v in buffers]

    for i in starts:
        c, at, _ = place(i)
        sims.put(at, -_sq(x[i : i + c], x))

    def unlike() -> Iterator[np.ndarray]:
        for i in starts:
            c, at, (s, *_) = place(i)
            off = np.ones((c, n), bool)
            off[np.arange(c), np.arange(i, i + c)] = False
            yield sims.get(at, s)[off]

    pref = _preference(preference, n, unlike, exchange) if isinstance(preference, str) else preference
    rng = np.random.default_rng(seed)
    for skip in range(0, a * n, 1 << 18):  # what the rows before take
        rng.standard_normal(min(1 << 18, a * n - skip))
    for i in starts:
        c, at, (s, *_) = place(i)
        sims.get(at, s)[np.arange(c), np.arange(i, i + c)] = pref
        sims.put(at, s + (np.finfo(float).eps * s + np.finfo(float).tiny * 100) * rng.standard_normal((c, n)))

    columns, available, same, last, k = np.zeros(n), np.zeros(n), 0, None, 0
    for k in range(1, iterations + 1):
        sums, own = np.zeros(n), np.zeros(b - a)
        for i in starts:
            c, at, (s, r, v, t) = place(i)
            rows, diagonal = np.arange(c), np.arange(i, i + c)
            sims.get(at, s)
            if k == 1:
                r[:], v[:] = 0, 0
            else:
                sent.get(2 * at, r)
                sent.get(2 * at + c * n, v)
                np.maximum(r, 0, out=t)
                np.subtract(columns, t, out=t)
                np.minimum(t, 0, out=t)
                t[rows, diagonal] = columns[diagonal] - r[rows, diagonal]
                v *= damping
                t *= 1 - damping
                v += t
            np.add(v, s, out=t)
            top = t.argmax(1)
            first = t[rows, top]
            t[rows, top] = -np.inf
            second = t.max(1)
            np.subtract(s, first[:, None], out=t)
            t[rows, top] = s[rows, top] - second
            r *= damping
            t *= 1 - damping
            r += t
            sent.put(2 * at, r)
            sent.put(2 * at + c * n, v)
            own[diagonal - a] = r[rows, diagonal]
            np.maximum(r, 0, out=t)
            t[rows, diagonal] = r[rows, diagonal]
            sums += t.sum(0)
        told = exchange(np.concatenate([sums, own]))
        columns, responsible = np.sum([v[:n] for v in told], axis=0), np.concatenate([v[n:] for v in told])
        available = damping * available + (1 - damping) * (columns - responsible)
        now = available + responsible > 0
        same = same + 1 if last is not None and (now == last).all() else 0
        last = now
        if same >= converge_after and now.any():
            break
    ex = np.flatnonzero(last) if last is not None else np.zeros(0, int)
    labels = [sims.get(at, s)[:, ex].argmax(1) for c, at, (s, *_) in map(place, starts)] if len(ex) else []
    return np.concatenate([[k, len(ex)], ex, *labels])


def spectral_embedding(affinity: np.ndarray, k: int) -> np.ndarray:
    """The k smoothest vectors on the graph of ``affinity``."""
    a = affinity.copy()
    np.fill_diagonal(a, 0)
    scale = np.sqrt(a.sum(1))
    scale[scale == 0] = 1
    values, v = np.linalg.eigh(a / np.outer(scale, scale))
    return _led(v[:, ::-1][:, :k] / scale[:, None])


def _led(u: np.ndarray) -> np.ndarray:
    """Columns with signs so that the entry of largest size is positive."""
    sign = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    return u * np.where(sign == 0, 1, sign)


class SpectralClustering:
    @staticmethod
    def fit(df: DataFrame, num_clusters: int, affinity: str = "rbf", gamma: float = 1.0, num_runs: int = 10, max_iterations: int = 300, features: str = "features", id: str = "id", seed: int = 0) -> DataFrame:
        """``affinity`` "precomputed": ``features`` holds a row's affinities to all rows, by rising id."""
        V.one_of(affinity, ("rbf", "precomputed"))
        ids, x = matrix(df, id, features)
        k = V.positive_integer(num_clusters)

        def part(x: np.ndarray, a: int, b: int, v: np.ndarray) -> np.ndarray:
            w = x[a:b].copy() if affinity == "precomputed" else np.exp(-gamma * squares(x[a:b], x))
            w[np.arange(b - a), np.arange(a, b)] = 0
            return w @ v

        with Slices(df.sparkSession, x) as rows:
            scale = np.sqrt(rows.each(part, np.ones((len(x), 1))))
            scale[scale == 0] = 1
            u = largest(lambda v: rows.each(part, v / scale) / scale, len(x), k, seed=seed)[1]
        u = _led(u / scale)
        rows = df.sparkSession.createDataFrame(pa.table({"id": ids, "features": pa.array(u.tolist(), pa.list_(pa.float64()))}))
        model = KMeans.fit(rows, num_clusters, max_iterations=max_iterations, num_runs=num_runs, seed=seed)
        return model.predict(rows, "label").select("id", "label")


# Metrics.


def silhouette_samples(df: DataFrame, label: str, features: str = "features", id: str = "id") -> DataFrame:
    """(id, label, silhouette), Euclidean; 0 in clusters of one. Sums of distances a row and cluster come from blocks of pairs."""
    from .neighbors import CHUNK, WIDE, _block_join

    def sums(ids: np.ndarray, q: np.ndarray, right: pa.Table) -> pa.Table:
        x = _matrix(right["x"])
        labels, code = np.unique(right["label"].to_numpy(), return_inverse=True)
        order = np.argsort(code, kind="stable")
        x, first = x[order], np.searchsorted(code[order], np.arange(len(labels)))
        total = np.concatenate([np.add.reduceat(np.sqrt(squares(q[at : at + CHUNK], x)), first, axis=1) for at in range(0, len(q), CHUNK)])
        return pa.table({"id": np.repeat(ids, len(labels)), "other": np.tile(labels.astype(np.int64), len(ids)), "s": total.ravel()})

    rows = df.select(F.col(id).cast("long").alias(id), features, F.col(label).cast("long").alias("label"))
    s = _block_join(rows, rows, id, features, sums, "id long, other long, s double", ["label"], WIDE).groupBy("id", "other").agg(F.sum("s").alias("s"))
    sizes = rows.groupBy(F.col("label").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    m = s.join(sizes, "other").join(rows.select(F.col(id).alias("id"), "label"), "id")
    inner = F.sum(F.when(F.col("other") == F.col("label"), F.col("s")))
    own_n = F.sum(F.when(F.col("other") == F.col("label"), F.col("n")))
    outer = F.min(F.when(F.col("other") != F.col("label"), F.col("s") / F.col("n")))
    g = m.groupBy("id", "label").agg(inner.alias("a"), own_n.alias("n"), outer.alias("b")).withColumn("a", F.col("a") / F.greatest(F.col("n") - 1, F.lit(1)))
    top = F.greatest("a", "b")
    return g.select("id", "label", F.when((F.col("n") == 1) | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("silhouette"))


def silhouette_score(df: DataFrame, label: str, features: str = "features", id: str = "id") -> DataFrame:
    return silhouette_samples(df, label, features, id).agg(F.avg("silhouette").alias("silhouette"))
