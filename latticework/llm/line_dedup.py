"""Line dedup: exact reference-count tables in shards, each with a cuckoo filter in front of it.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. The index holds
*postings* (key, doc_id), a *reference count* a key (documents that hold it, largest of them) and,
a shard, a cuckoo filter of the keys whose count has reached ``min_docs``. Documents can be inserted
and deleted again: counts go up and down, and a key's fingerprint enters or leaves its filter as the
count crosses the threshold, so that insert-then-delete restores the index exactly.

A posting meets its shard's filter in the shard's own tasks: both are dealt by shard and salt, the filter
comes first and the postings stream past it. So no filter is ever sent to all executors, at any size, and
a key that many documents hold is spread over salts. What the filters let through meets the exact table.

Defined results: a null text is one empty line, as an empty text is; rows with a null doc_id keep all
lines and count as no document; rows that repeat a doc_id count as one document, and each row is
cleaned by itself; extra columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, free_name, map_batches, partitions_of, text_bytes

WHITE = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of a shard, of whose filter each salt gets a copy (about 40 KB).
SHARD_KEYS = 1 << 14
#: Salts of a shard, at the least; there are more where few shards would leave tasks without work.
SALTS = 8


class CuckooFilter:
    """Partial-key cuckoo filter: buckets of four 16-bit fingerprints, with deletion."""

    SLOTS = 4

    def __init__(self, n_buckets: int, table: np.ndarray | None = None):
        self.n = n_buckets
        self.table = np.zeros((n_buckets, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        n = 1
        while n * cls.SLOTS * 0.84 < max(n_keys, 1):
            n *= 2
        return cls(n)

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = (h2.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        f[f == 0] = 1
        i = (h1.view(np.uint64) >> np.uint64(8)) & np.uint64(self.n - 1)
        return f, i.astype(np.int64), self._other(i.astype(np.int64), f)

    def _other(self, i, f):
        mixed = (f.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(24)
        return i ^ (mixed & np.uint64(self.n - 1)).astype(np.int64)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        f, i, j = self._places(h1, h2)
        return ((self.table[i] == f[:, None]) | (self.table[j] == f[:, None])).any(1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False if the filter is too full; its content is then undefined and a larger one is to be built."""
        f, i, j = self._places(h1, h2)
        for fp, a, b in zip(f.tolist(), i.tolist(), j.tolist()):
            if not (self._put(a, fp) or self._put(b, fp) or self._kick(a, fp)):
                return False
        return True

    def _put(self, at: int, fp: int) -> bool:
        row = self.table[at]
        for s in range(self.SLOTS):
            if row[s] == 0:
                row[s] = fp
                return True
        return False

    def _kick(self, at: int, fp: int) -> bool:
        for step in range(500):
            slot = (step * 7 + fp) % self.SLOTS
            self.table[at, slot], fp = fp, int(self.table[at, slot])
            at = int(self._other(np.array([at]), np.array([fp], np.uint16))[0])
            if self._put(at, fp):
                return True
        return False

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Remove keys that are in the filter."""
        f, i, j = self._places(h1, h2)
        for fp, a, b in zip(f.tolist(), i.tolist(), j.tolist()):
            for at in (a, b):
                hit = np.flatnonzero(self.table[at] == fp)
                if len(hit):
                    self.table[at, hit[0]] = 0
                    break


def _keys_of(data: bytes | None, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, 16-byte key hash) of the lines whose key has ``min_chars`` code points."""
    out = []
    for k, line in enumerate((data or b"").split(b"\n")):
        if len(line) >= min_chars and len(key := line.strip(WHITE)) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
            out.append((k, xxhash.xxh3_128_digest(key.lower())))
    return out


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id), once a row of ``docs`` and key."""

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, hashes = [], []
        for doc, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            own = {h for _, h in _keys_of(data, min_chars)}
            ids += [doc] * len(own)
            hashes += own
        h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])

    return map_batches(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), keys, "h1 long, h2 long, doc_id long")


@dataclass(frozen=True)
class LineIndex:
    """A generation of the index; ``insert`` and ``delete`` return the next one."""

    scratch: Scratch
    postings: DataFrame  # h1, h2, doc_id
    counts: DataFrame  # h1, h2, n_docs, max_doc
    filters: DataFrame  # shard, n_buckets, bits
    n_shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS
    generation: int = 0

    @staticmethod
    def create(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, n_shards: int | None = None) -> LineIndex:
        """Index of all of ``docs``."""
        scratch = Scratch(spark)
        postings = scratch.put(line_keys(docs, min_chars).distinct(), "postings_0")
        counts = scratch.put(_count(postings).where(F.col("n_docs") >= 1), "counts_0")
        if n_shards is None:
            n_hot = counts.where(F.col("n_docs") >= min_docs).count()
            n_shards = max(1, -(-n_hot // SHARD_KEYS))
        filters = scratch.put(_build_filters(counts.where(F.col("n_docs") >= min_docs), n_shards), "filters_0")
        return LineIndex(scratch, postings, counts, filters, n_shards, min_docs, min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents whose ids the index doesn't hold yet."""
        new = self.scratch.put(line_keys(docs, self.min_chars).distinct().join(self.postings.select("doc_id").distinct(), "doc_id", "left_anti").select("h1", "h2", "doc_id"), f"new_{self.generation + 1}")
        delta = _count(new)
        merged = self.counts.unionByName(delta).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
        return self._next(self.postings.unionByName(new), merged)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take documents out again (``doc_ids``: a column doc_id)."""
        gone = doc_ids.select(F.col("doc_id").cast("long")).distinct()
        left = self.postings.join(gone, "doc_id", "left_anti").select("h1", "h2", "doc_id")
        touched = self.scratch.put(self.postings.join(gone, "doc_id", "left_semi").select("h1", "h2").distinct(), f"gone_{self.generation + 1}")
        recounted = _count(left.join(touched, ["h1", "h2"], "left_semi"))
        return self._next(left, self.counts.join(touched, ["h1", "h2"], "left_anti").unionByName(recounted))

    def _next(self, postings: DataFrame, counts: DataFrame) -> LineIndex:
        g = self.generation + 1
        postings, counts = self.scratch.put(postings, f"postings_{g}"), self.scratch.put(counts, f"counts_{g}")
        hot = lambda t: t.where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
        n_hot = hot(counts).count()
        if n_hot > 2 * SHARD_KEYS * self.n_shards:  # shards that have grown too large are dealt anew
            n_shards = -(-n_hot // SHARD_KEYS)
            return replace(self, postings=postings, counts=counts, filters=self.scratch.put(_build_filters(hot(counts), n_shards), f"filters_{g}"), n_shards=n_shards, generation=g)
        added = hot(counts).join(hot(self.counts), ["h1", "h2"], "left_anti").withColumn("d", F.lit(1))
        lost = hot(self.counts).join(hot(counts), ["h1", "h2"], "left_anti").withColumn("d", F.lit(-1))
        tried = self.scratch.put(_update_filters(self.filters, added.unionByName(lost), self.n_shards, hot(counts)), f"tried_{g}")
        filters = self.scratch.put(_rebuilt(tried, self.n_shards, hot(counts)), f"filters_{g}")
        self.scratch.drop(f"tried_{g}")
        return replace(self, postings=postings, counts=counts, filters=filters, generation=g)

    def hot(self) -> DataFrame:
        """Keys in at least ``min_docs`` documents: (h1, h2, max_doc)."""
        return self.counts.where(F.col("n_docs") >= self.min_docs).select("h1", "h2", "max_doc")

    def drops(self) -> DataFrame:
        """(h1, h2, doc_id): where a key's lines go, everywhere but in the largest document that holds it.

        The filters take out nearly all postings; the join with the exact table decides.
        """
        return _probe(self.postings, self.filters, self.n_shards).join(self.hot(), ["h1", "h2"]).where("doc_id < max_doc").select("h1", "h2", "doc_id")


def _count(postings: DataFrame) -> DataFrame:
    return postings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _shard(n: int) -> F.Column:
    return F.pmod(F.col("h1"), F.lit(n)).cast("int")


FILTER_SCHEMA = "shard int, n_buckets int, bits binary"


def _filled(h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
    made = CuckooFilter.sized(len(h1))
    while not made.insert(h1, h2):
        made = CuckooFilter(made.n * 2)
    return made


def _filter_row(shard: int, made: CuckooFilter) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "n_buckets": pa.array([made.n], pa.int32()), "bits": pa.array([made.table.tobytes()], pa.binary())})


def _build_filters(hot: DataFrame, n_shards: int) -> DataFrame:
    """One filter a shard; a shard holds about SHARD_KEYS keys, which bounds the group."""

    def build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        h1, h2 = (group[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2"))
        return _filter_row(key[0].as_py(), _filled(h1, h2))

    return hot.select(_shard(n_shards).alias("shard"), "h1", "h2").groupBy("shard").applyInArrow(build, FILTER_SCHEMA)


def _update_filters(filters: DataFrame, changes: DataFrame, n_shards: int, hot: DataFrame) -> DataFrame:
    """Apply insertions (d = 1) and deletions (d = -1) to each shard's filter; an overfull one is rebuilt from the exact table. Bits are null where insertion failed."""

    def update(key: tuple[pa.Scalar, ...], old: pa.Table, new: pa.Table) -> pa.Table:
        h1, h2, d = (new[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("h1", "h2", "d"))
        if old.num_rows:
            n = old["n_buckets"][0].as_py()
            kept = CuckooFilter(n, np.frombuffer(old["bits"][0].as_py(), np.uint16).reshape(n, -1).copy())
            kept.delete(h1[d < 0], h2[d < 0])
            if kept.insert(h1[d > 0], h2[d > 0]):
                return _filter_row(key[0].as_py(), kept)
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n_buckets": pa.array([n], pa.int32()), "bits": pa.array([None], pa.binary())})
        now = d >= 0
        return _filter_row(key[0].as_py(), _filled(h1[now], h2[now]))

    sized = filters.select("shard", "n_buckets", "bits")
    grown = changes.select(_shard(n_shards).alias("shard"), "h1", "h2", "d")
    # A full filter is rebuilt from scratch, for which its shard's other keys come along as d = 0.
    crowded = grown.groupBy("shard").agg(F.sum("d").alias("net")).join(sized.select("shard", "n_buckets"), "shard", "left")
    used = hot.select(_shard(n_shards).alias("shard"), "h1", "h2").groupBy("shard").agg(F.count(F.lit(1)).alias("used"))
    full = crowded.join(used, "shard", "left").where("n_buckets is null or used > n_buckets * 4 * 0.9").select("shard")
    rest = hot.select(_shard(n_shards).alias("shard"), "h1", "h2").join(full, "shard", "left_semi").withColumn("d", F.lit(0))
    keep = sized.join(full, "shard", "left_anti")
    grown = grown.join(full, "shard", "left_anti").unionByName(rest)
    return keep.groupBy("shard").cogroup(grown.groupBy("shard")).applyInArrow(update, FILTER_SCHEMA)


def _rebuilt(filters: DataFrame, n_shards: int, hot: DataFrame) -> DataFrame:
    """``filters`` with those that have no bits made anew from all hot keys of their shards."""
    failed = filters.where("bits is null").select("shard")
    keys = hot.withColumn("shard", _shard(n_shards)).join(failed, "shard", "left_semi").select("h1", "h2")
    return filters.where("bits is not null").unionByName(_build_filters(keys, n_shards))


def _probe(postings: DataFrame, filters: DataFrame, n_shards: int) -> DataFrame:
    """The postings whose key the filter of their shard has."""
    n = partitions_of(postings.sparkSession)
    salts = max(SALTS, -(-4 * n // n_shards))
    nothing = {c: F.lit(None).cast("long") for c in ("h1", "h2", "doc_id")}
    copies = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "n_buckets", "bits").withColumns(nothing)
    dealt = postings.select(_shard(n_shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("n_buckets"), F.lit(None).cast("binary").alias("bits"), "h1", "h2", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None  # the shard and salt at hand, and their filter
        for batch in batches:
            shard, salt, kind = (batch.column(k).to_numpy() for k in range(3))
            h1, h2 = (batch.column(k).fill_null(0).to_numpy() for k in (5, 6))
            edge = np.flatnonzero((shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])) + 1
            hit = np.zeros(len(shard), bool)
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(shard)]):
                if (shard[a], salt[a]) != at:
                    at, own = (shard[a], salt[a]), None
                if kind[a] == 0:
                    size = batch.column(3)[a].as_py()
                    own, a = CuckooFilter(size, np.frombuffer(batch.column(4)[a].as_py(), np.uint16).reshape(size, -1)), a + 1
                if own is not None:  # a shard without a filter has no hot key
                    hit[a:b] = own.contains(h1[a:b], h2[a:b])
            if hit.any():
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(hit)) for k in (5, 6, 7)], ["h1", "h2", "doc_id"])

    return copies.unionByName(dealt).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(run, "h1 long, h2 long, doc_id long")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, index: LineIndex | None = None) -> DataFrame:
    """``docs`` without the lines that ``index`` (made of ``docs`` where none is given) says to drop.

    Returns the columns of ``docs`` with ``text`` cleaned (a null text stays null), and n_lines and
    n_dropped (long); columns of these names in ``docs`` keep theirs, the new ones then get a leading "_".
    """
    spark = docs.sparkSession
    index = index or LineIndex.create(spark, docs, min_docs, min_chars)
    min_chars = index.min_chars
    scratch, taken = index.scratch, docs.columns
    n_lines, n_dropped, drop, same = (free_name(taken, c) for c in ("n_lines", "n_dropped", "lw_drop", "lw_doc"))
    packed = F.concat(F.unhex(F.lpad(F.hex("h1"), 16, "0")), F.unhex(F.lpad(F.hex("h2"), 16, "0")))
    # A document's own keys: no more than its text has lines, which is already one row.
    lists = scratch.put(index.drops().groupBy(F.col("doc_id").alias(same)).agg(F.array_join(F.collect_list(F.hex(packed)), "").alias(drop)), f"drops_{index.generation}")
    # The lists grow with the corpus: always a merge join, never a broadcast that only small inputs could have.
    joined = docs.join(lists.hint("merge"), docs["doc_id"].cast("long") == lists[same], "left").drop(same)
    at, names = taken.index("text"), [*taken, drop]
    fields = [f for f in docs.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{n_lines}` long, `{n_dropped}` long"

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lines, dropped = [], [], []
        for data, gone in zip(text_bytes(batch.column(at)), batch.column(len(taken)).to_pylist()):
            split = (data or b"").split(b"\n")
            lines.append(len(split))
            if gone:
                raw = bytes.fromhex(gone)
                keys = {raw[k : k + 16][7::-1] + raw[k + 8 : k + 16][::-1] for k in range(0, len(raw), 16)}
                out = {k for k, h in _keys_of(data, min_chars) if h in keys}
                data = b"\n".join(line for k, line in enumerate(split) if k not in out)
            else:
                out = ()
            dropped.append(len(out))
            texts.append(data)
        columns = [batch.column(k) for k in range(len(taken))]
        columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*taken, n_lines, n_dropped])

    return map_batches(joined.select(*[docs[c] for c in taken], drop), clean, schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(regexp_replace(regexp_replace(ls[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, unnest(generate_series(1, len(ls))) AS g(i)),
k AS (SELECT key, max(doc_id) AS m FROM l WHERE length(key) >= 40 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id < k.m AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id
"""
