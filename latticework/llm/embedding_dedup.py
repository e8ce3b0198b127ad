"""Embedding near-dedup with a forest of random-projection trees whose splits overlap.

A tree splits the unit vectors by their projection on a random direction, again and again; vectors within
a margin of a split go down both sides. Each node splits at the median of the label that it has most of,
until no label has more than about 4 sqrt(n) of its n vectors in a leaf. Vectors of one label that meet in
a leaf are compared exactly, in double precision. The forest (directions, medians) is fitted to a sample
of at most SAMPLE vectors; every vector goes through it. Beyond SAMPLE^2 / 4 vectors a label, leaves are a
constant share of it, unless SAMPLE grows along.

The margin follows from the threshold: two unit vectors of cosine c are sqrt(2 - 2 c) apart, and their
projections differ by about that over the root of the dimension. ``trees_needed`` are as many as bring
the odds that a pair at the threshold shares no leaf of any tree below ``miss``.

A linked pair is counted in the first leaf that it shares only, so that counts of links add up without
a list of pairs; for the components a leaf gives one edge a vector. Equal vectors of a label are one
class with a weight. Leaves of over TILE vectors are cut into tiles, and each pair of tiles is a task,
so that dense groups stay exact.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors with
a null label, link with nothing; so do rows with a null vec_id, whose component is null. Vectors of
unlike dimensions never link. Rows equal in all of id, label and vector count once. Rows that share
an id but not the vector are separate vectors, except that they are one node of the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, connected_components, map_batches

THRESHOLD, SAMPLE, TILE = 0.93, 40_000, 1536
#: Vectors of the sample below which a node is not split, and levels of a tree at most.
LEAST, LEVELS = 8, 64
#: Half the distance at the threshold that the margin covers, in units of its spread along a direction.
WIDTH = 0.67


def trees_needed(depth: int, threshold: float, miss: float) -> int:
    """Trees of ``depth`` splits that keep the odds of a missed pair at the threshold below ``miss``."""
    far = math.sqrt(2 - 2 * threshold)
    beyond = 2 * (math.exp(-WIDTH * WIDTH / 2) / math.sqrt(2 * math.pi) - WIDTH * 0.5 * math.erfc(WIDTH / math.sqrt(2)))
    apart = 1 - (1 - min(0.9, far * beyond / math.sqrt(2 * math.pi))) ** depth
    # Twice the trees that vectors spread evenly would need: clusters put more of them near a split.
    return max(4, 2 * math.ceil(math.log(miss) / math.log(apart))) if depth else 0


@dataclass(frozen=True)
class Tree:
    """directions[l]: of level l. Of node v: its split and its first child (the second follows); a leaf has child 0."""

    directions: np.ndarray
    split: np.ndarray
    child: np.ndarray


@dataclass(frozen=True)
class Forest:
    dim: int
    margin: float
    trees: list[Tree]

    @staticmethod
    def fit(sample: np.ndarray, labels: np.ndarray, total: int, threshold: float = THRESHOLD, miss: float = 1e-7, seed: int = 11) -> Forest:
        """From unit vectors, a row each, and their labels as codes; ``total``: the vectors that there are in all."""
        dim = sample.shape[1]
        rng = np.random.default_rng(seed)
        margin = WIDTH * math.sqrt(2 - 2 * threshold) / math.sqrt(max(dim, 1)) / 2
        if not len(sample):
            return Forest(dim, margin, [])
        share = total / len(sample)
        most = np.maximum(4 * np.sqrt(np.bincount(labels) * share) / share, LEAST)  # of each label in a leaf, in sampled vectors

        def grow() -> tuple[Tree, int]:
            directions = rng.standard_normal((LEVELS, dim))
            directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-300)
            split, child, depth = [math.nan], [0], 0
            todo = [(0, 0, np.arange(len(sample)))]
            while todo:
                v, level, own = todo.pop()
                count = np.bincount(labels[own], minlength=len(most))
                main = int((count / most).argmax())
                if count[main] <= most[main] or level == LEVELS:
                    continue
                p = sample[own] @ directions[level]
                m = float(np.median(p[labels[own] == main]))
                if (np.abs(p - m) <= margin).mean() > 0.5:
                    continue  # too dense to part: a leaf
                split[v], child[v] = m, len(split)
                split += [math.nan] * 2
                child += [0, 0]
                todo += [(child[v], level + 1, own[p <= m]), (child[v] + 1, level + 1, own[p > m])]
                depth = max(depth, level + 1)
            return Tree(directions[:depth], np.array(split), np.array(child)), depth

        first, depth = grow()
        return Forest(dim, margin, [first] + [grow()[0] for _ in range(trees_needed(depth, threshold, miss) - 1)] if depth else [])

    def leaves(self, x: np.ndarray) -> list[list[int]]:
        """Codes of the leaves of each row of ``x``: tree << 16 | node, in rising order. Without trees, all meet in one leaf."""
        out: list[list[int]] = [[] for _ in range(len(x))]
        for t, tree in enumerate(self.trees):
            along = x @ tree.directions.T
            todo = [(0, 0, np.arange(len(x)))]
            while todo:
                v, level, own = todo.pop()
                if not len(own):
                    continue
                if not tree.child[v]:
                    for k in own.tolist():
                        out[k].append(t << 16 | v)
                    continue
                p = along[own, level] - tree.split[v]
                todo += [(tree.child[v], level + 1, own[p <= self.margin]), (tree.child[v] + 1, level + 1, own[p >= -self.margin])]
        return [sorted(c) for c in out] if self.trees else [[0]] * len(x)


def unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors of ``_usable``, a row each."""
    if len({len(r) for r in raw}) > 1:
        return np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * dim else "<f8").astype(np.float64) for r in raw])
    return np.frombuffer(b"".join(raw), "<f4" if len(raw[0]) == 4 * dim else "<f8").reshape(len(raw), dim)


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, k1, k2, vec): vec holds the components as little-endian floats where these are exact, else as doubles; unusable vectors have a null vec."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vec, keys, dims = [], [], []
        for v in batch.column(1).to_pylist():
            x = None if not v or any(c is None for c in v) else np.array(v, "<f8") + 0.0
            ok = x is not None and bool(np.isfinite(x).all()) and bool((x != 0).any())
            with np.errstate(over="ignore"):
                low = x.astype("<f4") if ok else None
            vec.append((low if (low == x).all() else x).tobytes() if ok else None)
            dims.append(len(x) if ok else None)
            keys.append(xxhash.xxh3_128_digest(x.tobytes()) if ok else b"\0" * 16)
        k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(dims, pa.int32()), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(vec, pa.binary())], ["vec_id", "label", "dim", "k1", "k2", "vec"])

    label = dict(vectors.dtypes)["label"]
    return map_batches(vectors.select(F.col("vec_id").cast("long"), "embedding", "label"), run, f"vec_id long, label {label}, dim int, k1 long, k2 long, vec binary")


def _spread(reps: DataFrame, forest: Forest, label: str) -> DataFrame:
    """A row a vector and leaf; ``codes`` are all of the vector's leaves."""
    sent = reps.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = sent.value
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                dims = np.array(batch.column(1).to_pylist())
                raw = batch.column(4).to_pylist()
                codes: list[list[int]] = [[0]] * batch.num_rows
                own = np.flatnonzero(dims == forest.dim)
                if len(own):
                    found = forest.leaves(unit(matrix([raw[i] for i in own], forest.dim)))
                    for i, c in zip(own.tolist(), found):
                        codes[i] = c
                n = np.array([len(c) for c in codes])
                rows = pa.array(np.repeat(np.arange(batch.num_rows), n))
                packed = pa.array([np.array(c, "<i4").tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(5)), pa.array(np.concatenate([np.array(c, np.int32) for c in codes])), packed.take(rows)], ["label", "dim", "rep", "weight", "vec", "leaf", "codes"])

    return reps.select("label", "dim", "rep", "weight", "vec").mapInArrow(run, f"label {label}, dim int, rep long, weight long, vec binary, leaf int, codes binary")


FOUND = "kind int, a long, b long"


def _linked(x: np.ndarray, threshold: float) -> np.ndarray:
    """The symmetric matrix of cosines that reach ``threshold``; those at its very edge are summed again without rounding."""
    g = x @ x.T
    out = g >= threshold
    for i, j in zip(*np.nonzero(np.abs(g - threshold) < 1e-12)):
        out[i, j] = math.fsum((x[i] * x[j]).tolist()) >= threshold
    np.fill_diagonal(out, False)
    return out | out.T


def _compare(threshold: float):
    def run(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        i, j, leaf = key[-2].as_py(), key[-1].as_py(), key[2].as_py()
        own = own.combine_chunks()
        ids, weight, tile = (own[c].to_numpy() for c in ("rep", "weight", "tile"))
        x = unit(matrix(own["vec"].to_pylist(), key[1].as_py()))
        links = _linked(x, threshold)
        if i != j:
            links &= tile[:, None] != tile[None, :]
        nothing = pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not links.any():
            return nothing
        keep = np.flatnonzero(links.any(1))
        links, ids, weight = links[np.ix_(keep, keep)], ids[keep], weight[keep]
        # Edges: each vector to the smallest of its component here.
        rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable").astype(np.int32)
        low = rank.copy()
        while True:
            new = np.minimum(low, np.where(links, low[None, :], len(ids)).min(1))
            if (new == low).all():
                break
            low = new
        by_rank = np.empty(len(ids), np.int64)
        by_rank[rank] = ids
        # Counts: pairs that share no earlier leaf.
        raw = own["codes"].to_pylist()
        codes = [np.frombuffer(raw[k], "<i4") for k in keep.tolist()]
        earlier = [c[c < leaf] for c in codes]
        seen = np.unique(np.concatenate(earlier))
        if len(seen):
            inside = np.zeros((len(ids), len(seen)), np.float32)
            for k, c in enumerate(earlier):
                inside[k, np.searchsorted(seen, c)] = 1
            links = links & ~(inside @ inside.T > 0)
        count = links @ weight
        return pa.table({
            "kind": pa.array(np.repeat(np.array([0, 1], np.int32), len(ids))),
            "a": pa.array(np.concatenate([ids, ids])),
            "b": pa.array(np.concatenate([count.astype(np.int64), by_rank[low]])),
        })

    return run


def link_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = 1e-7) -> DataFrame:
    """(vec_id, n_links, component_id), a row a row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    label = dict(vectors.dtypes)["label"]
    rows = scratch.put(_usable(vectors), "rows")
    usable = rows.where("vec is not null and label is not null and vec_id is not null")
    key = ["label", "k1", "k2"]
    reps = usable.groupBy(*key, "vec_id").agg(F.first("vec").alias("vec"), F.first("dim").alias("dim"))
    reps = reps.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec"), F.first("dim").alias("dim"))
    reps = scratch.put(reps, "reps")
    members = scratch.put(rows.select("vec_id", *key, (F.col("vec").isNotNull() & F.col("vec_id").isNotNull()).alias("ok")).join(reps.select(*key, "rep", "weight"), key, "left").select("vec_id", F.when(F.col("ok"), F.col("rep")).alias("rep"), F.when(F.col("ok"), F.col("weight")).alias("weight")), "members")
    shape = reps.groupBy("label", "dim").count().agg(F.max(F.struct("count", "dim")).alias("x"), F.sum("count").alias("n")).first()
    if not shape["n"]:
        return members.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    dim = shape["x"]["dim"]
    # The sample: at most SAMPLE vectors, those of the least hashes.
    share = min(1.0, 2 * SAMPLE / shape["n"])
    draw = F.xxhash64("k1", "k2")
    sample = reps.where((F.col("dim") == dim) & (F.pmod(draw, F.lit(1_000_000)) < int(share * 1_000_000) + 1)).select("vec", "label", draw.alias("draw"), "rep").orderBy("draw", "rep").limit(SAMPLE).collect()
    codes = {x: k for k, x in enumerate(dict.fromkeys(r["label"] for r in sample))}
    forest = Forest.fit(unit(matrix([bytes(r["vec"]) for r in sample], dim)), np.array([codes[r["label"]] for r in sample]), shape["n"], threshold, miss)
    spread = scratch.put(_spread(reps, forest, label), "spread")
    group = ["label", "dim", "leaf"]
    large = scratch.put(spread.groupBy(*group).count().where(F.col("count") > TILE).select(*group, F.ceil(F.col("count") / TILE).alias("tiles")), "large")
    if large.take(1):
        tiled = spread.join(large, group, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    else:
        tiled = spread.withColumn("tiles", F.lit(1).cast("long"))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tiled = tiled.select(*group, "rep", "weight", "vec", "codes", "tile", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"))
    found = scratch.put(tiled.groupBy(*group, "i", "j").applyInArrow(_compare(threshold), FOUND), "found")
    scratch.drop("rows", "reps", "spread", "large")
    counts = scratch.put(found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links")), "counts")
    comps = scratch.put(connected_components(scratch, found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "rep"), "comps")
    out = members.join(counts, "rep", "left").join(comps, "rep", "left")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("weight") - 1, F.col("weight") - 1, F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


SQL = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT a, b FROM p),
c AS (WITH RECURSIVE t(x, y) AS (SELECT x, y FROM r UNION SELECT t.x, p.b FROM t JOIN p ON t.y = p.a) SELECT x, min(y) AS m FROM t GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id)::BIGINT AS n_links, c.m AS component_id, e.vec_id = c.m AS kept
FROM embeddings e JOIN c ON c.x = e.vec_id
"""
