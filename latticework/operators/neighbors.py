"""Neighbour search: exact, by radius, and approximate; classifiers and regressors on top.

Exact search is a join of queries with the points in *blocks*: each task takes a slice of queries and a
slice of points, works on them with matrix products, and keeps the best k a query; the best of all
slices follow by one window. Neither side is broadcast whole, nor are all pairs ever rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import validation as V
from ..functions import vectors
from ..functions.lineage import checkpointed

#: Rows of a slice where a task has BLOCK^2 distances in memory at once, and where it goes through them by chunks of CHUNK queries.
BLOCK, WIDE, CHUNK = 2048, 16384, 256
#: Queries of a batch of ``pairwise``.
TOGETHER = 64


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def distances(q: np.ndarray, x: np.ndarray, metric: object = "euclidean") -> np.ndarray:
    """All distances of the rows of ``q`` and ``x``; differences are taken as such, so equal rows are 0 apart."""
    if isinstance(metric, tuple) and metric[0] == "minkowski":
        p = metric[1]
        metric = {1: "manhattan", 2: "euclidean", math.inf: "chebyshev", "infinity": "chebyshev"}.get(p, metric)
    if metric == "cosine":
        nq, nx = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 1 - (q @ x.T) / np.outer(nq, nx)
        return np.where(np.outer(nq == 0, np.ones(len(x))) + np.outer(np.ones(len(q)), nx == 0) > 0, 1.0, np.maximum(d, 0))
    out = np.zeros((len(q), len(x)))
    for k in range(q.shape[1]):
        d = np.abs(q[:, k, None] - x[None, :, k])
        if metric == "manhattan":
            out += d
        elif metric == "chebyshev":
            np.maximum(out, d, out=out)
        elif isinstance(metric, tuple):
            out += d ** metric[1]
        else:
            out += d * d
    if isinstance(metric, tuple):
        return out ** (1 / metric[1])
    if metric == "euclidean":
        return np.sqrt(out)
    if metric in ("squared_euclidean", "manhattan", "chebyshev"):
        return out
    raise ValueError(f"unknown metric {metric!r}")


def nearest(ids: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray, k: int, exclude_self: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, point id, euclidean distance) of the k nearest of each query; equal distances by id.

    Products choose what may be among them; those distances are taken by differences. Of equal points the k + 1 of the smallest ids are looked at.
    """
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    if len(ids) and len(own):
        order = np.argsort(own, kind="stable")
        own, x = own[order], x[order]
        group = np.unique(x, axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
        nth = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
        keep = np.sort(order[nth <= k])
        own, x = own[keep], x[keep]
        norms = (x * x).sum(1)
        for at in range(0, len(ids), 512):
            i, y = ids[at : at + 512], q[at : at + 512]
            near = (y * y).sum(1)[:, None] + norms - 2 * (y @ x.T)
            slack = 1e-12 * ((y * y).sum(1) + norms.max())
            if exclude_self:
                near[i[:, None] == own[None, :]] = np.inf
            last = min(k, len(own)) - 1
            limit = np.partition(near, last, axis=1)[:, last]
            r, c = np.nonzero((near <= (limit + slack)[:, None]) & np.isfinite(near))
            d = np.zeros(len(r))
            for j in range(x.shape[1]):
                d += (y[r, j] - x[c, j]) ** 2
            d = np.sqrt(d)
            order = np.lexsort((own[c], d, r))
            r, c, d = r[order], c[order], d[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < k
            for part, v in zip(parts, (i[r[keep]], own[c[keep]], d[keep])):
                part.append(v)
    return tuple(np.concatenate(p) for p in parts)


def within(q: np.ndarray, x: np.ndarray, radius: float, metric: object = "euclidean") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of q, row of x, distance) of the pairs with distance <= radius, chunk by chunk. Euclidean: products choose what may be near, differences decide."""
    norms = (x * x).sum(1)
    for at in range(0, len(q), CHUNK):
        y = q[at : at + CHUNK]
        if metric == "euclidean":
            own = (y * y).sum(1)[:, None]
            near = (-2 * y) @ x.T
            near += norms
            r, c = np.divmod(np.flatnonzero(near <= radius * radius - own + 1e-12 * (own + norms.max(initial=0))), len(x))
            d = np.zeros(len(r))
            for j in range(x.shape[1]):
                d += (y[r, j] - x[c, j]) ** 2
            d = np.sqrt(d)
            near = d <= radius
            yield r[near] + at, c[near], d[near]
        else:
            d = distances(y, x, metric)
            r, c = np.nonzero(d <= radius)
            yield r + at, c, d[r, c]


def _sliced(df: DataFrame, id: str, features: str, slices: int, extra: list[str]) -> DataFrame:
    return df.select(F.col(id).alias("id"), vectors.doubles(features).alias("x"), *extra, F.pmod(F.xxhash64(id), F.lit(slices)).cast("int").alias("slice"))


def _sliced_alike(df: DataFrame, id: str, features: str, slices: int, extra: list[str]) -> DataFrame:
    """As ``_sliced``, in the order of the vectors, so that equal ones are in one slice or in adjoining ones."""
    rows = df.select(F.col(id).alias("id"), vectors.doubles(features).alias("x"), *extra)
    return rows.repartitionByRange(slices, "x", "id").withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(slices)).cast("int"))


def _block_join(queries: DataFrame, points: DataFrame, id: str, features: str, kernel, schema: str, extra: list[str] = (), block: int = BLOCK, sliced=_sliced) -> DataFrame:
    """``kernel(q ids, q matrix, point table)`` on every pair of a slice of queries and a slice of points."""
    # Wide slices are copied less often; small tables still give some tasks.
    nq, nx = (max(1, -(-n // block), min(4, n // BLOCK)) for n in (df.count() for df in (queries, points)))
    q = sliced(queries, id, features, nq, []).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    x = sliced(points, id, features, nx, list(extra)).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    kernel_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kernel_schema.empty_table()
        return kernel(left["id"].to_numpy(), _matrix(left["x"]), right)

    # Few bytes may be many pairs: tasks are as many as the pairs of slices ask for, not as the bytes do.
    tasks = min(4 * nq * nx, max(nq * nx, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    q = q.withColumnsRenamed({"slice": "a", "other": "b"}).repartition(tasks, "a", "b")
    x = x.withColumnsRenamed({"other": "a", "slice": "b"}).repartition(tasks, "a", "b")
    return q.groupBy("a", "b").cogroup(x.groupBy("a", "b")).applyInArrow(run, schema)


NEIGHBORS = "query_id long, neighbor_id long, distance double"


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, rank from 0, neighbor_id, distance); equal distances by id."""
    w = W.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return pairs.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select("query_id", "rank", "neighbor_id", "distance")


@dataclass(frozen=True)
class BruteKNN:
    """Exact neighbours. ``points``: a frame with ``id`` and an array ``features``."""

    points: DataFrame
    num_neighbors: int
    id: str = "id"
    features: str = "features"
    metric: object = "euclidean"
    exclude_self: bool = False

    @staticmethod
    def fit(points: DataFrame, num_neighbors: int, **opts) -> BruteKNN:
        V.positive_integer(num_neighbors)
        return BruteKNN(points, num_neighbors, **opts)

    def predict(self, queries: DataFrame) -> DataFrame:
        if callable(self.metric):
            return self._by_column(queries)
        k, metric, skip = self.num_neighbors, self.metric, self.exclude_self

        def best(ids: np.ndarray, q: np.ndarray, right: pa.Table) -> pa.Table:
            own = right["id"].to_numpy()
            if metric in ("euclidean", "squared_euclidean"):
                a, b, d = nearest(ids, q, own, _matrix(right["x"]), k, skip)
                return pa.table({"query_id": a, "neighbor_id": b, "distance": d if metric == "euclidean" else d * d})
            d = distances(q, _matrix(right["x"]), metric)
            if skip:
                d[ids[:, None] == own[None, :]] = np.inf
            order = np.argsort(own, kind="stable")
            d, own = d[:, order], own[order]
            at = np.argsort(d, axis=1, kind="stable")[:, :k]
            rows = np.arange(len(ids))[:, None]
            keep = np.isfinite(d[rows, at])
            return pa.table({"query_id": np.repeat(ids, keep.sum(1)), "neighbor_id": own[at][keep], "distance": d[rows, at][keep]})

        block = WIDE if metric in ("euclidean", "squared_euclidean") else BLOCK
        return top_k(_block_join(queries, self.points, self.id, self.features, best, NEIGHBORS, block=block), k)

    def _by_column(self, queries: DataFrame) -> DataFrame:
        """For a metric given as a function that builds a Column."""
        slices = max(1, -(-self.points.count() // BLOCK))
        q = queries.select(F.col(self.id).alias("query_id"), vectors.doubles(self.features).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
        x = self.points.select(F.col(self.id).alias("neighbor_id"), vectors.doubles(self.features).alias("x"), F.pmod(F.xxhash64(self.id), F.lit(slices)).cast("int").alias("slice"))
        pairs = q.join(x.hint("merge"), "slice")
        if self.exclude_self:
            pairs = pairs.where("query_id <> neighbor_id")
        # The best of a slice of points first: a query has at most k rows a slice after that.
        w = W.partitionBy("slice", "query_id").orderBy("distance", "neighbor_id")
        best = pairs.select("slice", "query_id", "neighbor_id", self.metric(F.col("q"), F.col("x")).alias("distance")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= self.num_neighbors)
        return top_k(best.select("query_id", "neighbor_id", "distance"), self.num_neighbors)


def search_among(points: DataFrame, queries: DataFrame, candidates: DataFrame, k: int, id: str = "id", features: str = "features", metric: object = "euclidean") -> DataFrame:
    """The best k of given (query_id, neighbor_id) pairs, each counted once."""
    m = vectors.pairwise_metric(metric)
    # Vectors go through the joins as they are; single precision takes half the bytes.
    q = queries.select(F.col(id).alias("query_id"), F.col(features).alias("q"))
    x = points.select(F.col(id).alias("neighbor_id"), F.col(features).alias("x"))
    pairs = candidates.select("query_id", "neighbor_id").distinct().join(q, "query_id").join(x, "neighbor_id")
    return top_k(pairs.select("query_id", "neighbor_id", m(vectors.doubles("q"), vectors.doubles("x")).alias("distance")), k)


def half_up(v: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark's ``round`` does, by the decimals that a double is written with; no zero is negative."""
    scale = 10.0**digits
    y = np.abs(v) * scale
    whole = np.floor(y)
    with np.errstate(invalid="ignore"):
        rest = y - whole
        out = np.copysign((whole + (rest >= 0.5)) / scale, v)
        for i in np.argwhere(np.abs(rest - 0.5) <= 1e-6 + 4e-16 * y):
            out[tuple(i)] = float(Decimal(repr(float(v[tuple(i)]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(400)))
    return out + 0.0


def pairwise(left: DataFrame, right: DataFrame, metric: object = "euclidean", id: str = "id", features: str = "features", digits: int | None = None) -> DataFrame:
    """(query_id, neighbor_id, distance) of all pairs: as many rows as the result has cells, made block by block.

    Distances of equal rows are made, and with ``digits`` rounded, once a block. Rows come in the order of the
    vectors, so that equal distances are near each other and files with them stay small.
    """

    def every(ids: np.ndarray, q: np.ndarray, right: pa.Table) -> pa.Table:
        own = right["id"].to_numpy()
        (q, row), (x, column) = (np.unique(v, axis=0, return_inverse=True) for v in (q, _matrix(right["x"])))
        d = distances(q, x, metric)
        d = d if digits is None else half_up(d, digits)
        r, c = (np.argsort(v.ravel(), kind="stable") for v in (row, column))
        ids, row, own, d = ids[r], row.ravel()[r], own[c], d[:, column.ravel()[c]]
        # A few queries go together through the other side: either id, and of equal rows the distance, repeats in so few bytes that writers find it.
        parts = [slice(at, at + TOGETHER) for at in range(0, len(ids), TOGETHER)]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([np.tile(ids[p], len(own)), np.repeat(own, len(ids[p])), d[row[p]].T.ravel()], ["query_id", "neighbor_id", "distance"]) for p in parts])

    return _block_join(left, right, id, features, every, NEIGHBORS, sliced=_sliced_alike)


def radius_neighbors(points: DataFrame, queries: DataFrame, radius: float, id: str = "id", features: str = "features", metric: object = "euclidean", payload: list[str] | None = None, exclude_self: bool = False) -> DataFrame:
    """(query_id, neighbor_id, distance) of all pairs with distance <= radius; with ``exclude_self``, of unlike ids."""
    V.positive_number(radius)

    def near(ids: np.ndarray, q: np.ndarray, right: pa.Table) -> pa.Table:
        own = right["id"].to_numpy()
        a, b, d = (np.concatenate(v) for v in zip(*within(q, _matrix(right["x"]), radius, metric)))
        keep = ids[a] != own[b] if exclude_self else slice(None)
        return pa.table({"query_id": ids[a[keep]], "neighbor_id": own[b[keep]], "distance": d[keep]})

    out = _block_join(queries, points, id, features, near, NEIGHBORS, block=WIDE)
    if payload:
        out = out.join(points.select(F.col(id).alias("neighbor_id"), *payload), "neighbor_id")
    return out


def radius_sums(points: DataFrame, queries: DataFrame, radius: float, value: str, id: str = "id", features: str = "features", metric: object = "euclidean", exclude_self: bool = False) -> DataFrame:
    """(query_id, value, w): how many neighbours within the radius have a value; counted block by block, so that pairs are never rows."""
    V.positive_number(radius)
    kind = points.schema[value].dataType.simpleString()

    def count(ids: np.ndarray, q: np.ndarray, right: pa.Table) -> pa.Table:
        own = right["id"].to_numpy()
        coded = right["value"].combine_chunks().dictionary_encode(null_encoding="encode")
        code, size = coded.indices.to_numpy(), len(coded.dictionary)
        cells, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b, _ in within(q, _matrix(right["x"]), radius, metric):
            if exclude_self:
                keep = ids[a] != own[b]
                a, b = a[keep], b[keep]
            cell, n = np.unique(a * size + code[b], return_counts=True)
            cells.append(cell)
            counts.append(n)
        cell = np.concatenate(cells)
        return pa.table({"query_id": ids[cell // size], "value": coded.dictionary.take(pa.array(cell % size)), "w": np.concatenate(counts).astype(float)})

    out = _block_join(queries, points, id, features, count, f"query_id long, value {kind}, w double", [F.col(value).alias("value")], WIDE)
    return out.groupBy("query_id", "value").agg(F.sum("w").alias("w"))


def inverse_distance_weights(distance: Column, query: Column | str = "query_id") -> Column:
    """1 / distance; where a query has neighbours at 0, these weigh 1 and the others 0."""
    any_zero = F.max((distance == 0).cast("int")).over(W.partitionBy(query)) == 1
    return F.when(any_zero, (distance == 0).cast("double")).otherwise(1 / F.when(distance == 0, F.lit(None)).otherwise(distance))


# kd-tree.


def levels(n: int) -> int:
    return max(0, math.ceil(math.log2(n + 1)))


ROOT = 0


def parent(i: int) -> int:
    return (i - 1) // 2 if i else -1


def left_child(i: int) -> int:
    return 2 * i + 1


def right_child(i: int) -> int:
    return 2 * i + 2


@dataclass(frozen=True)
class KDTree:
    """A left-balanced tree over a bounded set of points, kept as an order of them; searched side by side by the tasks of a query frame."""

    ids: np.ndarray
    data: np.ndarray
    num_neighbors: int = 3
    metric: object = "euclidean"

    #: Points, and bytes of them, that one tree may hold; larger sets are for BruteKNN or RandomProjectionForest.
    LIMIT, BYTES = 2_000_000, 512 << 20
    #: Subtrees of about so few nodes are looked at as a whole.
    TOGETHER = 256

    @staticmethod
    def fit(points: DataFrame, id: str = "id", features: str = "features", num_neighbors: int = 3, metric: object = "euclidean") -> KDTree:
        n = points.count()
        if n > KDTree.LIMIT:
            raise ValueError(f"{n} points are more than a kd-tree holds ({KDTree.LIMIT})")
        size = 8 * n * (points.select(F.max(F.size(features))).first()[0] or 0)
        if size > KDTree.BYTES:
            raise ValueError(f"points of {size} bytes are more than a kd-tree holds ({KDTree.BYTES})")
        rows = points.select(F.col(id).cast("long").alias("id"), vectors.doubles(features).alias("x")).orderBy("id").toArrow()
        x = _matrix(rows["x"])
        order = KDTree.permutation(x)
        return KDTree(rows["id"].to_numpy()[order], x[order], num_neighbors, metric)

    @staticmethod
    def permutation(x: np.ndarray) -> np.ndarray:
        """Row of each node in heap order."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            node, own, depth = todo.pop()
            n = len(own)
            if not n:
                continue
            own = own[np.argsort(x[own, depth % x.shape[1]], kind="stable")]
            full = 1 << (n.bit_length() - 1)  # nodes of the last full level and above, plus one
            last = n - (full - 1)
            left = (full - 1) // 2 + min(last, full // 2)
            out[node] = own[left]
            todo += [(left_child(node), own[:left], depth + 1), (right_child(node), own[left + 1 :], depth + 1)]
        return out

    def search(self, q: np.ndarray) -> list[tuple[float, int]]:
        """(distance, id) of the nearest of one query."""
        d, ids = self.search_many(q[None, :])
        return [(float(x), int(i)) for x, i in zip(d[0], ids[0]) if i >= 0]

    def search_many(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids), a row a query, equal distances by id; id -1 where there are no more points.

        All queries first walk down to their leaf. Then each node is visited once, with the queries whose worst
        kept neighbour is not nearer than the planes between them and the node.
        """
        n, dim, k = len(self.ids), self.data.shape[1], self.num_neighbors
        best, found = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
        prune = self.metric != "cosine"

        def offer(node: np.ndarray, rows: np.ndarray) -> None:
            """``node``: one for all ``rows``, or one a row."""
            if node.ndim:
                for v in np.unique(node):
                    offer(v, rows[node == v])
                return
            own, d = self.ids[node], distances(q[rows], self.data[node][None, :], self.metric)[:, 0]
            last = best[rows, -1]
            new = ((d < last) | ((d == last) & ((found[rows, -1] < 0) | (own < found[rows, -1])))) & ~(found[rows] == own).any(1)
            if not new.any():
                return
            at = rows[new]
            dd, ii = np.hstack([best[at], d[new, None]]), np.hstack([found[at], np.full((len(at), 1), own)])
            order = np.lexsort((np.where(ii < 0, np.iinfo(np.int64).max, ii), dd), axis=1)[:, :k]
            best[at], found[at] = np.take_along_axis(dd, order, 1), np.take_along_axis(ii, order, 1)

        def offer_all(nodes: np.ndarray, rows: np.ndarray) -> None:
            own = self.ids[nodes]
            for at in range(0, len(rows), CHUNK):
                part = rows[at : at + CHUNK]
                d = distances(q[part], self.data[nodes], self.metric)
                for j in range(k):
                    d[found[part, j, None] == own] = np.inf
                new = np.isfinite(d.min(1)) & (d.min(1) <= best[part, -1])
                part, d = part[new], d[new]
                dd, ii = np.hstack([best[part], d]), np.hstack([found[part], np.broadcast_to(own, d.shape)])
                ii[np.isinf(dd)] = -1
                order = np.lexsort((np.where(ii < 0, np.iinfo(np.int64).max, ii), dd), axis=1)[:, :k]
                best[part], found[part] = np.take_along_axis(dd, order, 1), np.take_along_axis(ii, order, 1)

        node, rows, depth = np.zeros(len(q), np.int64), np.arange(len(q)), 0
        while prune and len(rows):
            offer(node, rows)
            off = q[rows, depth % dim] - self.data[node, depth % dim]
            node = np.where(off > 0, right_child(node), left_child(node))
            rows, node, depth = rows[node < n], node[node < n], depth + 1
        todo = [(0, 0, np.arange(len(q)), np.zeros(len(q)))]
        while todo:
            v, depth, rows, gap = todo.pop()
            if v >= n:
                continue
            if prune:
                near = gap <= best[rows, -1]
                rows, gap = rows[near], gap[near]
            if not len(rows):
                continue
            if n >> (depth + 1) < KDTree.TOGETHER:
                below = [np.arange(((v + 1) << r) - 1, min((v + 2 << r) - 1, n)) for r in range(n.bit_length()) if ((v + 1) << r) - 1 < n]
                offer_all(np.concatenate(below), rows)
                continue
            offer(np.int64(v), rows)
            off = q[rows, depth % dim] - self.data[v, depth % dim]
            reach = np.maximum(gap, off**2 if self.metric == "squared_euclidean" else np.abs(off))
            todo += [(left_child(v), depth + 1, rows, np.where(off > 0, reach, gap)), (right_child(v), depth + 1, rows, np.where(off > 0, gap, reach))]
        return best, found

    def predict(self, queries: DataFrame, id: str = "id", features: str = "features") -> DataFrame:
        sent = queries.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                d, ids = tree.search_many(_matrix(b.column(1)))
                there = ids >= 0
                rank = np.broadcast_to(np.arange(ids.shape[1], dtype=np.int32), ids.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), there.sum(1))), pa.array(rank[there]), pa.array(ids[there]), pa.array(d[there])], ["query_id", "rank", "neighbor_id", "distance"])

        asked = queries.select(F.col(id).cast("long").alias("query_id"), vectors.doubles(features).alias("x")).repartition(queries.sparkSession.sparkContext.defaultParallelism)
        return asked.mapInArrow(run, "query_id long, rank int, neighbor_id long, distance double")


# Random-projection forest and graphs.


@dataclass(frozen=True)
class RandomProjectionForest:
    """Trees of median splits: one random direction a tree and level, medians fitted on a bounded sample.

    Every point goes to one leaf a tree; queries look at the points of their leaves and rank them exactly.
    """

    points: DataFrame
    directions: np.ndarray  # tree, level, dimension
    medians: np.ndarray  # tree, node
    num_neighbors: int
    id: str = "id"
    features: str = "features"
    metric: object = "euclidean"

    SAMPLE = 50_000
    #: With ``recall``: queries that it is measured on, rows of a leaf at most before it is split, trees at most.
    PROBES, LEAF, TREES = 512, 2000, 512

    @staticmethod
    def fit(points: DataFrame, num_neighbors: int, num_trees: int | None = None, min_leaf_size: int | None = None, seed: int = 0, id: str = "id", features: str = "features", metric: object = "euclidean", recall: float | None = None) -> RandomProjectionForest:
        """``num_trees`` trees, or with ``recall`` as many as find that share of the true neighbours.

        The share is measured on PROBES points against exact search over all points, the point itself left
        out, and must be reached by three standard errors. Trees too many are avoided by larger leaves.
        """
        V.one_of(metric, ("euclidean", "squared_euclidean"))
        if (num_trees is None) == (recall is None):
            raise ValueError("either num_trees or recall is to be given")
        n = points.count()
        leaf = min_leaf_size or max(10, 2 * num_neighbors)
        if recall is None and n < 2 * leaf:
            raise ValueError(f"{n} points are too few for leaves of {leaf}")
        if recall is not None and min_leaf_size is None:
            leaf = max(leaf, min(n // 32, RandomProjectionForest.LEAF // 2))
        depth = int(math.log2(max(1.0, n / leaf)))
        rows = points.select(vectors.doubles(features).alias("x")).orderBy(F.xxhash64(id)).limit(RandomProjectionForest.SAMPLE).toArrow()
        x = _matrix(rows["x"])
        depth = min(depth, int(math.log2(max(2, len(x)))))
        if recall is None:
            directions = np.random.default_rng(seed).standard_normal((num_trees, depth, x.shape[1]))
            medians = np.array([RandomProjectionForest._medians(x, d) for d in directions]).reshape(num_trees, -1)
        else:
            directions, medians = RandomProjectionForest._enough(x, RandomProjectionForest._probes(points, num_neighbors, id, features), depth, recall, seed)
        return RandomProjectionForest(points, directions, medians, num_neighbors, id, features, metric)

    @staticmethod
    def _medians(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
        """Of the nodes of one tree."""
        medians, node = np.zeros(2 ** len(directions) - 1), np.zeros(len(x), np.int64)
        for level, direction in enumerate(directions):
            p = x @ direction
            for v in range(2**level - 1, 2 ** (level + 1) - 1):
                own = p[node == v]
                medians[v] = np.median(own) if len(own) else 0.0
            node = 2 * node + 1 + (p > medians[node])
        return medians

    @staticmethod
    def _descend(x: np.ndarray, directions: np.ndarray, medians: np.ndarray) -> np.ndarray:
        """Leaf of each row in one tree."""
        node = np.zeros(len(x), np.int64)
        for direction in directions:
            node = 2 * node + 1 + (x @ direction > medians[node])
        return node

    @staticmethod
    def _probes(points: DataFrame, k: int, id: str, features: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the probe, probe, neighbour) of each true pair of the probes."""
        own = points.orderBy(F.xxhash64(id, F.lit("probe")), id).limit(RandomProjectionForest.PROBES)
        pairs = BruteKNN.fit(points, k, id=id, features=features, exclude_self=True).predict(own)
        q = own.select(F.col(id).alias("query_id"), vectors.doubles(features).alias("q"))
        x = points.select(F.col(id).alias("neighbor_id"), vectors.doubles(features).alias("x"))
        found = pairs.join(q, "query_id").join(x, "neighbor_id").select("query_id", "q", "x").toArrow()
        return np.unique(found["query_id"].to_numpy(), return_inverse=True)[1], _matrix(found["q"]), _matrix(found["x"])

    @staticmethod
    def _enough(x: np.ndarray, probes: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int, recall: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(directions, medians) of the first trees that reach ``recall``; one level less where TREES do not."""
        number, q, near = probes
        size = np.bincount(number)
        for levels in range(depth, -1, -1):
            rng, hit = np.random.default_rng(seed), np.zeros(len(q), bool)
            directions, medians = [], []
            while len(medians) < RandomProjectionForest.TREES:
                directions.append(rng.standard_normal((levels, x.shape[1])))
                medians.append(RandomProjectionForest._medians(x, directions[-1]))
                hit |= RandomProjectionForest._descend(q, directions[-1], medians[-1]) == RandomProjectionForest._descend(near, directions[-1], medians[-1])
                share = np.bincount(number, hit) / size
                if levels == 0 or share.mean() - 3 * share.std() / math.sqrt(len(share)) >= recall:
                    return np.array(directions), np.array(medians)
        raise AssertionError("one leaf has all points")

    def leaves(self, df: DataFrame) -> DataFrame:
        """(id, tree, leaf)."""
        directions, medians = self.directions, self.medians

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = _matrix(b.column(1))
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for t in range(len(medians)):
                    node = RandomProjectionForest._descend(x, directions[t], medians[t])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(x), t, np.int32)), pa.array(node)], ["id", "tree", "leaf"])

        return df.select(F.col(self.id).cast("long").alias("id"), vectors.doubles(self.features).alias("x")).mapInArrow(run, "id long, tree int, leaf long")

    def candidates(self, queries: DataFrame) -> DataFrame:
        q, x = self.leaves(queries).withColumnRenamed("id", "query_id"), self.leaves(self.points).withColumnRenamed("id", "neighbor_id")
        return q.join(x, ["tree", "leaf"]).select("query_id", "neighbor_id").distinct()

    def _in_leaves(self, df: DataFrame, is_query: bool, is_point: bool) -> DataFrame:
        """A row a vector and tree, the vector as it is: single precision takes half the bytes."""
        directions, medians = self.directions, self.medians
        kind = df.schema[self.features].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    x, n = _matrix(b.column(1)), b.num_rows
                    for t in range(len(medians)):
                        node = RandomProjectionForest._descend(x, directions[t], medians[t])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(node), b.column(0), pa.array([is_query] * n), pa.array([is_point] * n), b.column(1)], ["tree", "leaf", "id", "is_query", "is_point", "x"])

        return df.select(F.col(self.id).cast("long").alias("id"), F.col(self.features).alias("x")).mapInArrow(run, f"tree int, leaf long, id long, is_query boolean, is_point boolean, x {kind}")

    def predict(self, queries: DataFrame, exclude_self: bool = False) -> DataFrame:
        """The best k of all leaves of a query: each leaf gives its own best k, so that candidates are never rows."""
        k, squared = self.num_neighbors, self.metric == "squared_euclidean"
        rows = self._in_leaves(queries, True, True) if queries is self.points else self._in_leaves(queries, True, False).unionAll(self._in_leaves(self.points, False, True))

        def run(leaf: pa.Table) -> pa.Table:
            ids, x = leaf["id"].to_numpy(), _matrix(leaf["x"])
            asks, there = (leaf[c].to_numpy().astype(bool) for c in ("is_query", "is_point"))
            a, b, d = nearest(ids[asks], x[asks], ids[there], x[there], k, exclude_self)
            return pa.table({"query_id": a, "neighbor_id": b, "distance": d * d if squared else d})

        return top_k(rows.groupBy("tree", "leaf").applyInArrow(run, NEIGHBORS).dropDuplicates(["query_id", "neighbor_id"]), k)


def expand(graph: DataFrame, points: DataFrame, k: int, id: str = "id", features: str = "features", metric: object = "euclidean") -> DataFrame:
    """A graph (query_id, neighbor_id) with neighbours of neighbours looked at as well, best k kept."""
    e = graph.select("query_id", "neighbor_id")
    two = e.join(e.select(F.col("query_id").alias("neighbor_id"), F.col("neighbor_id").alias("far")), "neighbor_id").where("far <> query_id").select("query_id", F.col("far").alias("neighbor_id"))
    return search_among(points, points, e.unionAll(two), k, id, features, metric)


class LargeVis:
    """An approximate neighbour graph: a forest first, of ``num_trees`` trees or of ``recall``, then rounds of neighbours of neighbours."""

    @staticmethod
    def fit(points: DataFrame, num_neighbors: int, num_iters: int = 3, min_leaf_size: int | None = None, num_trees: int | None = None, seed: int = 0, id: str = "id", features: str = "features", metric: object = "euclidean", recall: float | None = None) -> DataFrame:
        trees = None if recall is not None and num_trees is None else num_trees or 5 + round(points.count() ** 0.25)
        forest = RandomProjectionForest.fit(points, num_neighbors, trees, min_leaf_size, seed, id, features, metric, recall)
        graph = checkpointed(forest.predict(points, exclude_self=True))
        for _ in range(num_iters):
            graph = checkpointed(expand(graph, points, num_neighbors, id, features, metric))
        return graph


@dataclass(frozen=True)
class NNDescent:
    """A neighbour graph improved by comparing a point's neighbours, both ways, until few edges change.

    It starts from a forest, with ``recall`` from one that finds that share of the true neighbours: where
    near points have few neighbours in common, the rounds alone end far from the true graph.
    """

    points: DataFrame
    graph: DataFrame
    num_neighbors: int
    id: str = "id"
    features: str = "features"
    metric: object = "squared_euclidean"
    rounds: int = 0

    @staticmethod
    def fit(points: DataFrame, num_neighbors: int, max_candidates: int = 60, max_iterations: int = 300, tol: float = 1e-4, tree_init: bool = True, seed: int = 0, id: str = "id", features: str = "features", metric: object = "squared_euclidean", recall: float | None = None) -> NNDescent:
        k, n = num_neighbors, points.count()
        if tree_init and recall is not None:
            start = RandomProjectionForest.fit(points, k, None, None, seed, id, features, "euclidean", recall).predict(points, exclude_self=True)
        elif tree_init and n >= 4 * max(10, k):
            start = RandomProjectionForest.fit(points, k, 5 + round(n**0.25), None, seed, id, features, "euclidean").candidates(points).where("query_id <> neighbor_id")
        else:
            from .model_selection import row_numbers

            # k partners a point: the point that stands so many places further on a ring of all ids, for k random shifts.
            ring = checkpointed(row_numbers(points.select(F.col(id).alias("query_id")), "query_id", "r")[0])
            few = min(k, n - 1)
            draws = np.random.default_rng(seed).permutation(n - 1)[:few] if n < 1 << 20 else np.unique(np.random.default_rng(seed).integers(0, n - 1, 4 * few))[:few]
            shifts = ring.withColumn("s", F.explode(F.array(*[F.lit(int(s) + 1) for s in draws])))
            start = shifts.select("query_id", ((F.col("r") + F.col("s")) % n).alias("r")).join(ring.withColumnRenamed("query_id", "neighbor_id"), "r").select("query_id", "neighbor_id")
        graph = checkpointed(search_among(points, points, start, k, id, features, metric).withColumn("new", F.lit(True)))
        rounds = 0
        for rounds in range(1, max_iterations + 1):
            both = graph.select("query_id", "neighbor_id", "new").unionAll(graph.select(F.col("neighbor_id").alias("query_id"), F.col("query_id").alias("neighbor_id"), "new")).groupBy("query_id", "neighbor_id").agg(F.max("new").alias("new"))
            draw = W.partitionBy("query_id", "new").orderBy(F.xxhash64("query_id", "neighbor_id", F.lit(seed + rounds)))
            near = both.withColumn("r", F.row_number().over(draw)).where(F.col("r") <= max_candidates)
            a, b = near.select(F.col("query_id").alias("h"), F.col("neighbor_id").alias("query_id"), F.col("new").alias("na")), near.select(F.col("query_id").alias("h"), "neighbor_id", F.col("new").alias("nb"))
            pairs = a.join(b, "h").where("(na or nb) and query_id <> neighbor_id").select("query_id", "neighbor_id").distinct()
            old = graph.select("query_id", "neighbor_id")
            better = search_among(points, points, pairs.unionAll(old), k, id, features, metric)
            graph_next = checkpointed(better.join(old.withColumn("old", F.lit(True)), ["query_id", "neighbor_id"], "left").withColumn("new", F.col("old").isNull()).drop("old"))
            changed = graph_next.where("new").count()
            graph = graph_next
            if changed < tol * n * k:
                break
        return NNDescent(points, graph.select("query_id", "rank", "neighbor_id", "distance"), k, id, features, metric, rounds)

    def prepare(self, max_degree: int | None = None, trees: int = 8, seed: int = 1) -> SearchGraph:
        """A graph for searching, kept for any number of queries.

        An edge goes if a nearer neighbour of its point is nearer to the other end than the point is. What is
        left counts both ways, ``max_degree`` nearest edges a point; a forest gives the places to start from.
        """
        x = self.points.select(F.col(self.id).alias("i"), vectors.doubles(self.features).alias("x"))
        m = vectors.pairwise_metric(self.metric)
        near = self.graph.select("query_id", "neighbor_id", "distance")
        with_x = near.join(x, F.col("neighbor_id") == F.col("i")).select("query_id", "neighbor_id", "distance", "x")
        nearer = with_x.select("query_id", F.col("distance").alias("d2"), F.col("neighbor_id").alias("other"), F.col("x").alias("x2"))
        hidden = with_x.join(nearer, "query_id").where((F.col("d2") < F.col("distance")) & (m("x", "x2") < F.col("distance"))).select("query_id", "neighbor_id").distinct()
        kept = near.join(hidden, ["query_id", "neighbor_id"], "left_anti")
        both = kept.unionAll(kept.select(F.col("neighbor_id").alias("query_id"), F.col("query_id").alias("neighbor_id"), "distance")).distinct()
        w = W.partitionBy("query_id").orderBy("distance", "neighbor_id")
        edges = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= (max_degree or 3 * self.num_neighbors)).select(F.col("query_id").alias("n"), F.col("neighbor_id").alias("m"))
        forest = RandomProjectionForest.fit(self.points, self.num_neighbors, trees, None, seed, self.id, self.features, "euclidean")
        return SearchGraph(self.points, checkpointed(edges), forest, self.id, self.features, self.metric)

    def query(self, queries: DataFrame, num_neighbors: int | None = None, trees: int = 8, seed: int = 1) -> DataFrame:
        """Neighbours of new points, by a graph made for this call; ``prepare`` makes one to keep."""
        return self.prepare(None, trees, seed).query(queries, num_neighbors or self.num_neighbors)


@dataclass(frozen=True)
class SearchGraph:
    """Best-first search along the edges of a pruned neighbour graph, all queries in step."""

    points: DataFrame
    edges: DataFrame  # n, m
    forest: RandomProjectionForest
    id: str = "id"
    features: str = "features"
    metric: object = "squared_euclidean"

    def query(self, queries: DataFrame, num_neighbors: int, pool: int | None = None, width: int = 4) -> DataFrame:
        """(query_id, rank, neighbor_id, distance).

        Each query keeps the best ``pool`` points seen. A round goes on from the best ``width`` of these that
        it has not gone on from yet; the search ends when every query has gone on from all that it keeps.
        """
        pool = max(pool or 4 * num_neighbors, num_neighbors)
        m = vectors.pairwise_metric(self.metric)
        q = queries.select(F.col(self.id).alias("query_id"), vectors.doubles(self.features).alias("q"))
        x = self.points.select(F.col(self.id).alias("neighbor_id"), vectors.doubles(self.features).alias("x"))
        best = W.partitionBy("query_id").orderBy("distance", "neighbor_id")
        open_best = W.partitionBy("query_id", "done").orderBy("distance", "neighbor_id")

        def measured(pairs: DataFrame) -> DataFrame:
            return pairs.join(q, "query_id").join(x, "neighbor_id").select("query_id", "neighbor_id", m("q", "x").alias("distance"), F.lit(False).alias("done"))

        def cut(rows: DataFrame) -> DataFrame:
            return checkpointed(rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= pool).drop("r"))

        state = cut(measured(self.forest.candidates(queries)))
        while True:
            marked = state.withColumn("go", ~F.col("done") & (F.row_number().over(open_best) <= width))
            go = marked.where("go")
            if not go.take(1):
                break
            steps = go.join(self.edges, F.col("neighbor_id") == F.col("n")).select("query_id", F.col("m").alias("neighbor_id")).distinct()
            new = measured(steps.join(state, ["query_id", "neighbor_id"], "left_anti"))
            state = cut(marked.select("query_id", "neighbor_id", "distance", (F.col("done") | F.col("go")).alias("done")).unionByName(new))
        return top_k(state, num_neighbors)


def is_in(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """``left`` with a flag of membership."""
    flag = right.select(column).distinct().withColumn("is_in", F.lit(True))
    return left.join(flag, column, "left").withColumn("is_in", F.coalesce("is_in", F.lit(False)))


class MinHeap:
    """A bounded heap of (distance, id)."""

    def __init__(self, items: list[tuple[float, int]] = ()):
        import heapq

        self._q, self.items = heapq, list(items)
        heapq.heapify(self.items)

    def insert(self, distance: float, id: int) -> None:
        self._q.heappush(self.items, (distance, id))

    def pop(self) -> tuple[float, int]:
        return self._q.heappop(self.items)

    def size(self) -> int:
        return len(self.items)


def neighbors_recall(true: DataFrame, pred: DataFrame) -> DataFrame:
    """Share of the true (query_id, neighbor_id) that ``pred`` has."""
    hit = pred.select("query_id", "neighbor_id").distinct().withColumn("hit", F.lit(1))
    return true.select("query_id", "neighbor_id").join(hit, ["query_id", "neighbor_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


# Votes and means over neighbours.


@dataclass(frozen=True)
class KNNClassifier:
    search: object  # anything with predict(queries) -> (query_id, rank, neighbor_id, distance)
    labels: DataFrame  # id, label
    num_classes: int
    weights: str = "uniform"

    @staticmethod
    def fit(points: DataFrame, label: str, num_classes: int, num_neighbors: int, weights: str = "uniform", algorithm: str = "brute", id: str = "id", features: str = "features", metric: object = "euclidean", **opts) -> KNNClassifier:
        V.one_of(weights, ("uniform", "distance"))
        return KNNClassifier(_search(algorithm, points, num_neighbors, id, features, metric, opts), points.select(F.col(id).alias("neighbor_id"), F.col(label).alias("label")), num_classes, weights)

    def _votes(self, queries: DataFrame) -> DataFrame:
        found = self.search.predict(queries)
        w = F.lit(1.0) if self.weights == "uniform" else inverse_distance_weights(F.col("distance"))
        return found.withColumn("w", w).join(self.labels, "neighbor_id").groupBy("query_id", "label").agg(F.sum("w").alias("w"))

    def predict(self, queries: DataFrame) -> DataFrame:
        """(query_id, label): most weight; the smallest label of equal ones."""
        return self._votes(queries).groupBy("query_id").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("s")).select("query_id", (-F.col("s.l")).alias("label"))

    def predict_probability(self, queries: DataFrame) -> DataFrame:
        """(query_id, label, probability) of labels with a vote."""
        total = F.sum("w").over(W.partitionBy("query_id"))
        return self._votes(queries).select("query_id", "label", (F.col("w") / F.when(total == 0, 1.0).otherwise(total)).alias("probability"))


def _search(algorithm: str, points: DataFrame, k: int, id: str, features: str, metric: object, opts: dict):
    V.one_of(algorithm, ("brute", "kd_tree", "random_projection_forest"))
    if algorithm == "brute":
        return BruteKNN.fit(points, k, id=id, features=features, metric=metric, **opts)
    if algorithm == "kd_tree":
        tree = KDTree.fit(points, id, features, k, metric)
        return _Bound(lambda q: tree.predict(q, id, features))
    return RandomProjectionForest.fit(points, k, opts.pop("num_trees", 10), id=id, features=features, metric=metric, **opts)


@dataclass(frozen=True)
class _Bound:
    predict: object = field(repr=False)


@dataclass(frozen=True)
class KNNRegressor:
    search: object
    targets: DataFrame
    weights: str = "uniform"

    @staticmethod
    def fit(points: DataFrame, target: str, num_neighbors: int, weights: str = "uniform", algorithm: str = "brute", id: str = "id", features: str = "features", metric: object = "euclidean", **opts) -> KNNRegressor:
        V.one_of(weights, ("uniform", "distance"))
        return KNNRegressor(_search(algorithm, points, num_neighbors, id, features, metric, opts), points.select(F.col(id).alias("neighbor_id"), F.col(target).cast("double").alias("y")), weights)

    def predict(self, queries: DataFrame) -> DataFrame:
        w = F.lit(1.0) if self.weights == "uniform" else inverse_distance_weights(F.col("distance"))
        found = self.search.predict(queries).withColumn("w", w).join(self.targets, "neighbor_id")
        return found.groupBy("query_id").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("prediction"))


@dataclass(frozen=True)
class RadiusNNClassifier:
    points: DataFrame
    label: str
    num_classes: int
    radius: float = 1.0
    weights: str = "uniform"
    id: str = "id"
    features: str = "features"
    metric: object = "euclidean"
    exclude_self: bool = False

    @staticmethod
    def fit(points: DataFrame, label: str, num_classes: int, **opts) -> RadiusNNClassifier:
        return RadiusNNClassifier(points, label, num_classes, **opts)

    def radius_neighbors(self, queries: DataFrame) -> DataFrame:
        return radius_neighbors(self.points, queries, self.radius, self.id, self.features, self.metric, [F.col(self.label).alias("label")], self.exclude_self)

    def _votes(self, queries: DataFrame) -> DataFrame:
        if self.weights == "uniform":
            return radius_sums(self.points, queries, self.radius, self.label, self.id, self.features, self.metric, self.exclude_self).withColumnRenamed("value", "label")
        return self.radius_neighbors(queries).withColumn("w", inverse_distance_weights(F.col("distance"))).groupBy("query_id", "label").agg(F.sum("w").alias("w"))

    def predict(self, queries: DataFrame) -> DataFrame:
        """(query_id, label); -1 without any neighbour in the radius."""
        best = self._votes(queries).groupBy("query_id").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("s")).select("query_id", (-F.col("s.l")).alias("label"))
        return queries.select(F.col(self.id).alias("query_id")).join(best, "query_id", "left").select("query_id", F.coalesce("label", F.lit(-1)).alias("label"))

    def predict_probability(self, queries: DataFrame) -> DataFrame:
        """(query_id, label, probability, outlier): outliers have one row, without label."""
        total = F.sum("w").over(W.partitionBy("query_id"))
        p = self._votes(queries).select("query_id", "label", (F.col("w") / total).alias("probability"))
        return queries.select(F.col(self.id).alias("query_id")).join(p, "query_id", "left").withColumn("outlier", F.col("label").isNull())


@dataclass(frozen=True)
class RadiusNNRegressor:
    points: DataFrame
    target: str
    radius: float = 1.0
    weights: str = "uniform"
    id: str = "id"
    features: str = "features"
    metric: object = "euclidean"
    exclude_self: bool = False

    @staticmethod
    def fit(points: DataFrame, target: str, **opts) -> RadiusNNRegressor:
        return RadiusNNRegressor(points, target, **opts)

    def radius_neighbors(self, queries: DataFrame) -> DataFrame:
        return radius_neighbors(self.points, queries, self.radius, self.id, self.features, self.metric, [F.col(self.target).cast("double").alias("y")], self.exclude_self)

    def predict(self, queries: DataFrame) -> DataFrame:
        """(query_id, prediction); NaN without any neighbour in the radius."""
        if self.weights == "uniform":
            pairs = radius_sums(self.points.withColumn(self.target, F.col(self.target).cast("double")), queries, self.radius, self.target, self.id, self.features, self.metric, self.exclude_self).withColumnRenamed("value", "y")
        else:
            pairs = self.radius_neighbors(queries).withColumn("w", inverse_distance_weights(F.col("distance")))
        mean = pairs.groupBy("query_id").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("prediction"))
        return queries.select(F.col(self.id).alias("query_id")).join(mean, "query_id", "left").select("query_id", F.coalesce("prediction", F.lit(float("nan"))).alias("prediction"))


@dataclass(frozen=True)
class KNNImputer:
    """Missing cells take the mean of the column over the k nearest rows of ``donors`` that have it.

    Distance over the cells that both rows have, scaled up by their share; the search is the block join.
    A row is no donor of a row with its own id.
    """

    donors: DataFrame
    id: str
    cols: list[str]
    num_neighbors: int = 2
    missing_values: float | None = None

    @staticmethod
    def fit(df: DataFrame, id: str, cols: list[str], num_neighbors: int = 2, missing_values: float | None = None) -> KNNImputer:
        return KNNImputer(df, id, cols, V.positive_integer(num_neighbors), missing_values)

    @staticmethod
    def fit_transform(df: DataFrame, id: str, cols: list[str], num_neighbors: int = 2, missing_values: float | None = None) -> DataFrame:
        return KNNImputer.fit(df, id, cols, num_neighbors, missing_values).transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with its missing cells filled from the donors."""
        id, cols, missing_values = self.id, self.cols, self.missing_values
        known = [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.col(c) == F.lit(missing_values) if missing_values is not None else F.lit(False)), F.lit(float("nan"))).otherwise(F.col(c).cast("double")) for c in cols]
        rows, donors = (t.select(F.col(id).cast("long").alias(id), F.array(*known).alias("x")) for t in (df, self.donors))
        p, k = len(cols), self.num_neighbors

        def best(ids: np.ndarray, q: np.ndarray, right: pa.Table) -> pa.Table:
            own, x = right["id"].to_numpy(), _matrix(right["x"])
            order = np.argsort(own, kind="stable")
            own, x = own[order], x[order]
            qk, xk = ~np.isnan(q), ~np.isnan(x)
            d, both = np.zeros((len(q), len(x))), np.zeros((len(q), len(x)))
            for j in range(p):
                there = qk[:, j, None] & xk[None, :, j]
                both += there
                d += np.where(there, np.nan_to_num(q[:, j, None] - x[None, :, j]) ** 2, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.where(both > 0, np.sqrt(d * p / both), np.inf)
            d[ids[:, None] == own[None, :]] = np.inf
            found = []
            for j in range(p):
                for r in np.flatnonzero(~qk[:, j]):
                    donors = np.flatnonzero(xk[:, j] & np.isfinite(d[r]))
                    for c in donors[np.argsort(d[r, donors], kind="stable")[:k]]:
                        found.append((ids[r], own[c], d[r, c], j, x[c, j]))
            a, b, dist, col, val = zip(*found) if found else ((), (), (), (), ())
            return pa.table({"query_id": pa.array(a, pa.int64()), "neighbor_id": pa.array(b, pa.int64()), "distance": pa.array(dist, pa.float64()), "j": pa.array(col, pa.int32()), "v": pa.array(val, pa.float64())})

        holes = rows.where(F.exists("x", F.isnan))
        pairs = _block_join(holes, donors, id, "x", best, NEIGHBORS + ", j int, v double")
        w = W.partitionBy("query_id", "j").orderBy("distance", "neighbor_id")
        fills = pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("query_id", "j").agg(F.avg("v").alias("v"))
        wide = fills.groupBy(F.col("query_id").alias(id)).pivot("j", list(range(p))).agg(F.first("v"))
        out = df.join(wide, id, "left")
        return out.select(*[c for c in df.columns if c not in cols], *[F.when(F.isnan(e), F.col(f"`{j}`")).otherwise(e).alias(c) for j, (c, e) in enumerate(zip(cols, known))])
