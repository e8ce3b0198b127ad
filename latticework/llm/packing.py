"""Best-two-fit packing of token pieces into sequences.

A bin is filled greedily, always with the longest piece that fits. Then its smallest piece is taken
out again if two unpacked pieces fill the widened gap more tightly than it did, and they go in.

Only lengths matter to the choice, and there are no more than ``capacity`` of them: a group of pieces
is packed on the counts of its lengths. Groups are drawn at random and hold about
GROUP pieces each, so that they are packed side by side at any corpus size; each leaves less than
one bin's slack at its end. Pieces of full length are sequences by themselves and enter no group.
Sequences are numbered within their group; sequence_id joins the two numbers.

Defined results: a null text counts as empty and gives one piece, of the end id alone; repeated rows
are packed one by one; an empty table gives no rows; other columns of the documents are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, map_batches
from ._tokens import default_path, encoder

CAPACITY, END_ID, GROUP = 4096, 1, 40_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row a piece: a document's ids and the end id, cut after every ``capacity`` ids."""
    path = path or default_path()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = encoder(path)
        keys = batch.column(0).to_pylist()
        doc, piece, start, length, crc = [], [], [], [], []
        for first, ids, bounds in words.runs(batch.column(1)):
            raw = ids.tobytes()
            for key, a, b in zip(keys[first:], bounds.tolist(), bounds[1:].tolist()):
                own = raw[4 * a : 4 * b] + end
                for k in range(0, len(own), 4 * capacity):
                    part = own[k : k + 4 * capacity]
                    doc.append(key)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), cut, PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; no piece is longer than ``capacity``."""
    count = np.bincount(lengths, minlength=capacity + 1).tolist()
    there = 0  # bit n: an unpacked piece of length n is left
    for n, c in enumerate(count):
        there |= (c > 0) << n
    below = [(2 << n) - 1 for n in range(capacity + 1)]

    def longest(most: int) -> int:
        """The longest unpacked piece of at most that length; -1 if there is none."""
        return (there & below[most]).bit_length() - 1 if most >= 0 else -1

    def take(n: int) -> None:
        nonlocal there
        count[n] -= 1
        if not count[n]:
            there ^= 1 << n

    def put_back(n: int) -> None:
        nonlocal there
        if not count[n]:
            there |= 1 << n
        count[n] += 1

    def pair(gap: int, over: int) -> tuple[int, int] | None:
        """Two unpacked pieces of at most ``gap`` together, as long as they can be, and longer than ``over``."""
        best, found = over, None
        a = longest(gap)
        while a >= 0 and 2 * a > best:
            count[a] -= 1
            b = longest(min(a, gap - a)) if count[a] or a > gap - a else longest(min(a - 1, gap - a))
            count[a] += 1
            if b >= 0 and a + b > best:
                best, found = a + b, (a, b)
                if best == gap:
                    break
            a = longest(a - 1)
        return found

    order = np.argsort(lengths, kind="stable")
    first = np.searchsorted(lengths[order], np.arange(capacity + 2))
    taken = first[:-1].tolist()
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n_bins = 0
    while there:
        gap, inside = capacity, []
        while (n := longest(gap)) >= 0:
            take(n)
            inside.append(n)
            gap -= n
        if gap and there:
            least = inside[-1]  # pieces go in by falling length; it may be the only one
            if swap := pair(gap + least, least):
                inside.pop()
                for n in swap:
                    take(n)
                put_back(least)
                inside += swap
        at = 0
        for n in inside:
            k = order[taken[n]]
            taken[n] += 1
            bins[k], offsets[k] = n_bins, at
            at += n
        n_bins += 1
    return bins, offsets


PACKED = PIECES + ", sequence_id long, offset long"
_GROUP_BITS = 22  # sequences of a group; a group has no more bins than pieces


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``rows`` (PIECES, as a written table) with sequence_id and offset."""
    n_groups = max(1, -(-rows.where(F.col("length") < capacity).count() // group))
    # Drawn by place in the written table, not by key, so that repeated rows spread as well; a task that runs again draws the same.
    key = F.floor(F.rand(5) * n_groups)

    def run(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        own = own.combine_chunks().sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_two_fit(own["length"].to_numpy(), capacity)
        ids = (key[0].as_py() + 1) * (1 << _GROUP_BITS) + bins
        return own.drop_columns(["g"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    part = rows.where(F.col("length") < capacity).select("doc_id", "piece", "start", "length", "ids_crc32", key.alias("g")).groupBy("g").applyInArrow(run, PACKED)
    # Numbers below zero: no group has them.
    full = rows.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return part.unionByName(full)


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All documents as pieces, packed."""
    scratch = Scratch(docs.sparkSession)
    return pack(scratch.put(pieces(docs, path, capacity, end_id), "pieces"), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
