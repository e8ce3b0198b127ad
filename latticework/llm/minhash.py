"""MinHash near-dedup with tensored banding.

A document's set holds its distinct ``width``-word shingles. Two collections of ``m`` sub-keys, each
of ``half`` minimums, are computed: 2 m half minimums. Every pair of a sub-key of the first and one of
the second collection is a table key, so that m^2 tables of 2 half minimums cost the minimums of
about a square root of them. At similarity s a pair of documents shares no table only if one of the
collections has no sub-key in common: odds below 2 (1 - s^half)^m.

Documents of equal sets are one document from then on, that of the smallest id. Each member of a bucket is
paired with the bucket's first, and pairs whose minimums are unlike (an estimate under ``floor``: at 0.8,
128 minimums fall under 0.5 with odds of 1e-14) go. What the other pairs connect is a pool. Two documents
of similarity 0.8 share about a sixth of the tables, and one bucket whose first is like both of them, or
is one of them, puts them into one pool.

Full sets decide, in two steps. First, each document is compared with the most alike of the firsts that it
is paired with; the links found make *stars*, which hold nearly all of a group of near copies after as many
comparisons as it has documents. Then, in a pool that is more than one star, every document outside the
largest star is compared with all documents of the pool outside its own star: in one task for usual pools,
in tiles of TILE documents for large ones. So a group of near copies of any size is whole, at a cost that
grows with its size times the number of documents outside its largest star, and no list of pairs is made.

Defined results: null, empty or blank texts have an empty set and link with nothing; rows with a null
doc_id link with nothing and have a null component; rows that repeat a doc_id are one node, judged
with each of their texts; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, connected_components, free_name, map_batches, partitions_of, text_bytes
from ._words import mix, windows, word_runs


@dataclass(frozen=True)
class Tensored:
    """``m`` sub-keys of ``half`` minimums in each of the two collections."""

    m: int = 16
    half: int = 4
    floor: float = 0.5
    seed: int = 7

    @property
    def n_minimums(self) -> int:
        return 2 * self.m * self.half

    def factors(self) -> np.ndarray:
        return mix(np.arange(1, self.n_minimums + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed)) | np.uint64(1)

    def minimums(self, shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """The upper halves of the minimums; at least one shingle is needed."""
        least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(shingles), 4096):
            np.minimum(least, (shingles[k : k + 4096, None] * factors).min(0), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)

    def keys(self, minimums: np.ndarray) -> np.ndarray:
        """m^2 table keys a row of minimums."""
        part = minimums.reshape(len(minimums), 2, self.m, self.half).astype(np.uint64)
        sub = np.zeros(part.shape[:3], np.uint64)
        for k in range(self.half):
            sub = mix(sub * np.uint64(0x100000001B3) + part[..., k] + np.uint64(1))
        tables = np.arange(self.m * self.m, dtype=np.uint64).reshape(self.m, self.m)
        both = mix(sub[:, 0, :, None] + tables) ^ (sub[:, 1, None, :] * np.uint64(0xD6E8FEB86659FD93))
        return mix(both).reshape(len(minimums), -1)


def shingle_set(data: bytes | None, width: int) -> set[tuple[bytes, ...]]:
    """The set itself, for exact comparison."""
    words = (data or b"").lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width))))


def signatures(docs: DataFrame, width: int, plan: Tensored) -> DataFrame:
    """(doc_id, n_shingles, s1, s2: a 128-bit name of the set, minimums), a row a row of ``docs``."""
    factors = plan.factors()

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, s1, s2, low = [], [], [], []
        for first, last, names, split, _, _ in word_runs(batch.column(1), lower=True):
            for k in range(last - first):
                own = names[split[k] : split[k + 1]]
                shingles = np.unique(windows(own, min(width, max(len(own), 1)), seed=min(width, len(own)))) if len(own) else own
                n.append(len(shingles))
                s1.append(shingles.sum(dtype=np.uint64))
                s2.append(mix(shingles).sum(dtype=np.uint64))
                low.append(plan.minimums(shingles, factors).tobytes() if len(shingles) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), pa.array(low, pa.binary())], ["doc_id", "n_shingles", "s1", "s2", "minimums"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), sign, "doc_id long, n_shingles long, s1 long, s2 long, minimums binary")


def _table_rows(reps: DataFrame, plan: Tensored) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                low = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(part.num_rows, -1)
                keys = plan.keys(low)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "doc"])

    return reps.select("doc_id", "minimums").mapInArrow(run, "key long, doc long")


def _members(rows: DataFrame) -> DataFrame:
    """(a, b): every further member of a bucket with its first.

    Reads rows in the order of their keys, one batch at a time, whatever a bucket's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key and first document of the bucket that the batch before ended in
        for batch in batches:
            key, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(head, len(key)))
            first = np.repeat(doc[head], size)
            if last is not None and key[0] == last[0]:
                first[: size[0]] = last[1]
            last = (key[-1], first[-1])
            more = doc != first
            if more.any():
                pairs = np.unique(np.stack([doc[more], first[more]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    n = partitions_of(rows.sparkSession)
    return rows.repartition(n, "key").sortWithinPartitions("key", "doc").mapInArrow(run, "a long, b long")


def _estimate(pairs: DataFrame, reps: DataFrame, plan: Tensored, floor: float) -> DataFrame:
    """``pairs`` (a, b) with the share of equal minimums, where it reaches ``floor``."""
    low = reps.select("doc_id", "minimums")
    both = pairs.join(low.withColumnsRenamed({"doc_id": "a", "minimums": "ma"}), "a").join(low.withColumnsRenamed({"doc_id": "b", "minimums": "mb"}), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ma, mb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
        share = (ma == mb).mean(1)
        keep = share >= floor
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], ["a", "b", "share"]).filter(pa.array(keep))

    return map_batches(both.select("a", "b", "ma", "mb"), run, "a long, b long, share double")


def linked(x: set, y: set, percent: int) -> bool:
    common = len(x & y)
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def _stars(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) that are linked. A star's many rows are on the pairs' side of the join, where Spark splits them."""
    left = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    both = left.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")).hint("merge"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, center = None, set()
        for batch in batches:
            keep = []
            for b, ta, tb in zip(batch.column(1).to_pylist(), text_bytes(batch.column(2)), text_bytes(batch.column(3))):
                if (b, tb) != last:
                    last, center = (b, tb), shingle_set(tb, width)
                keep.append(linked(shingle_set(ta, width), center, percent))
            out = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if out.num_rows:
                yield out

    return both.mapInArrow(run, "a long, b long")


def _edges_of_sets(left: list[tuple[int, int, set]], right: list[tuple[int, int, set]], percent: int) -> list[tuple[int, int]]:
    """Edges between the stars of (doc, star, set) that connect all that are linked; what is connected already is not compared again."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        root.setdefault(k, k)
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    edges = []
    for _, star, own in left:
        for _, other, its in right:
            if 100 * min(len(own), len(its)) >= percent * max(len(own), len(its)) and find(star) != find(other) and linked(own, its, percent):
                root[find(star)] = find(other)
                edges.append((star, other))
    return edges


def _edges_of_matrix(left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """The same for many: sizes of all intersections at once, from the names of the shingles.

    Columns are the shingles that both sides have: a matrix of 0 and 1 a side, so many columns at a time.
    """
    names = [np.concatenate([x[2] for x in side]) for side in (left, right)]
    owner = [np.repeat(np.arange(len(side)), [len(x[2]) for x in side]) for side in (left, right)]
    both = np.intersect1d(*names)
    place = [np.minimum(np.searchsorted(both, n), max(len(both) - 1, 0)) for n in names]
    there = [both[p] == n if len(both) else np.zeros(len(n), bool) for p, n in zip(place, names)]
    common = np.zeros((len(left), len(right)), np.float32)
    order = [np.flatnonzero(t)[np.argsort(p[t], kind="stable")] for t, p in zip(there, place)]
    for first in range(0, len(both), COLUMNS):
        x = []
        for side, o, p, n in zip((left, right), order, place, owner):
            a, b = np.searchsorted(p[o], [first, first + COLUMNS])
            x.append(np.zeros((len(side), min(COLUMNS, len(both) - first)), np.float32))
            x[-1][n[o[a:b]], p[o[a:b]] - first] = 1
        common += x[0] @ x[1].T
    size = [np.array([len(x[2]) for x in side]) for side in (left, right)]
    stars = [np.array([x[1] for x in side]) for side in (left, right)]
    common = common.astype(np.int64)
    hit = (common > 0) & (100 * common >= percent * (size[0][:, None] + size[1][None, :] - common)) & (stars[0][:, None] != stars[1][None, :])
    i, j = np.nonzero(hit)
    return list(map(tuple, np.unique(np.stack([stars[0][i], stars[1][j]], 1), axis=0).tolist())) if len(i) else []


#: Shingles of a matrix at a time.
COLUMNS = 4096


def _pool_links(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) between stars, of the rows (pool, i, j, side, doc, star, text) of each (pool, i, j), which come one after another."""

    def edges(rows: list[tuple]) -> list[tuple[int, int]]:
        sides: list[list[tuple]] = [[], []]
        if len(rows) <= SMALL_POOL:
            sets: dict[bytes, set] = {}
            for _, side, doc, star, text in rows:
                if text not in sets:
                    sets[text] = shingle_set(text, width)
                sides[side].append((doc, star, sets[text]))
            return _edges_of_sets(*sides, percent)
        for first, last, names, split, _, _ in word_runs(pa.array([r[4] for r in rows], pa.binary()), lower=True):
            for k in range(last - first):
                own = names[split[k] : split[k + 1]]
                _, side, doc, star, _ = rows[first + k]
                sides[side].append((doc, star, np.unique(windows(own, min(width, max(len(own), 1)), seed=min(width, len(own))))))
        return _edges_of_matrix(*sides, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            if len({r[1] for r in pool}) == 2 and (found := edges(pool)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)))
            for key, side, doc, star, text in zip(keys, *(batch.column(k).to_pylist() for k in (3, 4, 5)), text_bytes(batch.column(6))):
                if pool and pool[0][0] != key:
                    yield from out()
                    pool = []
                pool.append((key, side, doc, star, text))
        yield from out()

    n = partitions_of(rows.sparkSession)
    return rows.repartition(n, "pool", "i", "j").sortWithinPartitions("pool", "i", "j").mapInArrow(run, "a long, b long")


#: Documents of a tile, bytes of text that count as one document, and rows up to which sets are compared one by one.
TILE, TILE_BYTES, SMALL_POOL = 512, 16_384, 64


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, plan: Tensored = Tensored()) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row a row of ``docs``; a component is what links of ``percent`` connect."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    signed = scratch.put(signatures(docs, width, plan), "signed")
    # Classes of equal sets, by their 128-bit names and sizes.
    name = ["n_shingles", "s1", "s2"]
    least = scratch.put(signed.where("n_shingles > 0 and doc_id is not null").groupBy(*name).agg(F.min("doc_id").alias("rep")), "least")
    members = scratch.put(signed.select("doc_id", *name).join(least, name, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "members")
    reps = signed.where("n_shingles > 0").join(least.select(F.col("rep").alias("doc_id"), *name), ["doc_id", *name], "left_semi").select("doc_id", "minimums")
    reps = scratch.put(reps, "reps")
    scratch.drop("signed", "least")
    stars = scratch.put(_members(_table_rows(reps, plan)), "stars")
    scratch.release()
    near = scratch.put(_estimate(stars.distinct(), reps, plan, plan.floor), "near")
    scratch.drop("stars", "reps")
    scratch.release()
    pools = connected_components(scratch, near.select("a", "b"), "pools").withColumnsRenamed({"node": "doc", "component": "pool"})
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    texts = scratch.put(own.join(pools.select("doc").hint("merge"), "doc"), "texts")
    scratch.release()
    # Each document with the most alike of the firsts that it is paired with.
    best = near.groupBy("a").agg(F.max(F.struct("share", (-F.col("b")).alias("b"))).alias("x")).select("a", (-F.col("x.b")).alias("b"))
    joined = scratch.put(_stars(scratch.put(best, "best"), texts, width, percent), "joined")
    scratch.drop("best", "near")
    scratch.release()
    star_of = connected_components(scratch, joined, "star_of").withColumnsRenamed({"node": "doc", "component": "star"})
    placed = scratch.put(pools.join(star_of, "doc", "left").select("pool", "doc", F.coalesce("star", "doc").alias("star")), "placed")
    sizes = placed.groupBy("pool", "star").agg(F.count(F.lit(1)).alias("n"))
    mixed = scratch.put(sizes.groupBy("pool").agg(F.max(F.struct("n", "star")).alias("top"), F.count(F.lit(1)).alias("stars")).where("stars > 1").select("pool", F.col("top.star").alias("largest")), "mixed")
    # The documents of pools of several stars; those outside the largest star are compared with all.
    rows = placed.join(mixed.hint("merge"), "pool").join(texts.hint("merge"), "doc")
    rows = scratch.put(rows.select("pool", "doc", "star", "text", (F.col("star") != F.col("largest")).alias("outside"), (1 + F.octet_length("text") / TILE_BYTES).alias("weight")), "rows")
    scratch.drop("texts", "mixed", "placed")
    scratch.release()
    tiles = scratch.put(rows.groupBy("pool").agg(F.ceil(F.sum(F.when(F.col("outside"), F.col("weight"))) / TILE).alias("ni"), F.ceil(F.sum("weight") / TILE).alias("nj")), "tiles")
    tiled = rows.join(tiles.hint("merge"), "pool")
    at = F.xxhash64("doc")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = tiled.where("outside").select("pool", F.pmod(at, F.col("ni")).alias("i"), every("nj").alias("j"), F.lit(0).alias("side"), "doc", "star", "text")
    others = tiled.select("pool", every("ni").alias("i"), F.pmod(at, F.col("nj")).alias("j"), F.lit(1).alias("side"), "doc", "star", "text")
    links = scratch.put(_pool_links(asked.unionAll(others), width, percent), "links")
    scratch.drop("rows", "tiles")
    scratch.release()
    # Stars that are linked; a star has the name of its smallest document.
    comps = connected_components(scratch, links, "components").withColumnsRenamed({"node": "star"})
    final = scratch.put(star_of.join(comps, "star", "left").select("doc", F.coalesce("component", "star").alias("component")).unionAll(comps.join(star_of.select("star").distinct(), "star", "left_anti").select("star", "component")), "final")
    return members.join(final.withColumnRenamed("doc", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def dedup_near(docs: DataFrame, width: int = 5, percent: int = 80, plan: Tensored = Tensored()) -> DataFrame:
    """``docs`` with one document a component: the one of the smallest id. Rows with a null doc_id stay.

    Of rows that repeat a doc_id, all stay if their document does.
    """
    node = free_name(docs.columns, "lw_node")
    gone = near_duplicates(docs, width, percent, plan).where("component_id <> doc_id").select(F.col("doc_id").alias(node)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[node], "left_anti")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=2).withColumn("kept", F.col("doc_id") == F.col("component_id"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM d, unnest(generate_series(1, greatest(len(w) - 1, least(len(w), 1)))) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT g, row_number() OVER () AS k, count(*) AS c FROM s GROUP BY g),
o AS (SELECT s.doc_id, k.k, k.c, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY k.c, k.k) AS r FROM s JOIN k USING (g) JOIN n USING (doc_id)),
-- Two sets of a similarity of 0.8 share one of the rarest fifth of either: only those few are joined.
f AS (SELECT doc_id, k, n FROM o WHERE r <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM f a JOIN f b ON a.k = b.k AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
p AS (SELECT c.a, c.b FROM c JOIN o x ON x.doc_id = c.a JOIN o y ON y.doc_id = c.b AND y.k = x.k GROUP BY c.a, c.b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (WITH RECURSIVE t(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT t.x, l.b FROM t JOIN l ON t.y = l.a) SELECT x, min(y) AS m FROM t GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.m AS component_id, d.doc_id = r.m AS kept FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.x = d.doc_id
"""
