"""Token ids in training order: fixed-stride binary shards under a keyed permutation.

Documents are tokenised, ended with ``end_id`` and laid end to end, a partition at a time; every
``stride`` ids are a sequence, and only a partition's last one is padded with ``pad_id``. A sequence's
*parts* tell which ids of which documents it holds. Sequences are numbered 0 to N - 1 by their place in
the token table; a keyed Feistel network over the next power of four, walked until the value is below N,
is a permutation of these numbers and gives each sequence its slot. Slots are dealt out by ranges: a
shard holds ``shard_size`` slots, slot s at byte (s mod shard_size) * stride * item size of shard
s div shard_size, so that a reader goes on from any slot with one seek and reads in training order.

A shard is written under another name and then renamed, so a task that is run again replaces it whole.
Shards go through pyarrow's file systems to ``out``, which must be a folder that all executors share.

Defined results: a null text counts as empty and is its end id alone; a null doc_id is carried as null;
repeated rows are documents by themselves; an empty table gives no shard; other columns are not carried.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, delete, partitions_of, shared_dir
from ._tokens import default_path, encoder

STRIDE, SHARD_SIZE, END_ID, PAD_ID = 512, 8192, 1, 0


@dataclass(frozen=True)
class Feistel:
    """A permutation of 0 .. n - 1 for each key."""

    n: int
    key: int
    rounds: int = 8

    @property
    def half_bits(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _round(self, x: np.ndarray, r: int) -> np.ndarray:
        c = np.array([(self.key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64)], np.uint64)
        h = (x + c) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        return (h ^ (h >> np.uint64(29))) & np.uint64((1 << self.half_bits) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        bits, low = np.uint64(self.half_bits), np.uint64((1 << self.half_bits) - 1)
        left, right = x >> bits, x & low
        for r in reversed(range(self.rounds)) if back else range(self.rounds):
            if back:
                left, right = right ^ self._round(left, r), left
            else:
                left, right = right, left ^ self._round(right, r)
        return left << bits | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        y = self._once(x.astype(np.uint64), back)
        while len(out := np.flatnonzero(y >= self.n)):
            y[out] = self._once(y[out], back)
        return y.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def item_type(vocab_size: int) -> np.dtype:
    return np.dtype("<u2") if vocab_size <= 1 << 16 else np.dtype("<u4")


PART = "doc_id long, start long, at long, length long"


class _Stream:
    """Documents end to end, given out as sequences."""

    def __init__(self, stride: int, item: np.dtype):
        self.stride, self.ids = stride, np.zeros(0, item)
        self.keys, self.start, self.size = pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        self.keys = pa.concat_arrays([self.keys, keys.cast(pa.int64())])
        self.start, self.size = np.concatenate([self.start, np.zeros(len(size), np.int64)]), np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])

    def take(self, rest: bool = False) -> pa.RecordBatch:
        """All whole sequences so far; with ``rest``, also the one that is not full."""
        stride, total = self.stride, len(self.ids)
        n = -(-total // stride) if rest else total // stride
        done = min(n * stride, total)
        first = np.cumsum(self.size) - self.size
        cuts = np.union1d(first[first < done], np.arange(n) * stride)
        doc = np.searchsorted(first, cuts, "right") - 1
        length = np.diff(np.append(cuts, done))
        part = pa.StructArray.from_arrays([self.keys.take(pa.array(doc)), pa.array(self.start[doc] + cuts - first[doc]), pa.array(cuts % stride), pa.array(length)], ["doc_id", "start", "at", "length"])
        ends = np.append(np.flatnonzero(cuts % stride == 0), len(cuts)).astype(np.int32)
        raw, width = self.ids[:done].tobytes(), stride * self.ids.itemsize
        out = pa.RecordBatch.from_arrays([pa.array([raw[k * width : (k + 1) * width] for k in range(n)], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), part)], ["ids", "parts"])
        if done < total:
            k = int(np.searchsorted(first, done, "right")) - 1
            gone = done - first[k]
            self.keys, self.start, self.size = self.keys.slice(k), self.start[k:].copy(), self.size[k:].copy()
            self.start[0] += gone
            self.size[0] -= gone
        else:
            self.keys, self.start, self.size = self.keys.slice(len(self.keys)), self.start[:0], self.size[:0]
        self.ids = self.ids[done:]
        return out


def sequences(docs: DataFrame, path: str, stride: int, end_id: int) -> DataFrame:
    """(ids: little-endian, unpadded; parts: array of PART), a row a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        stream = _Stream(stride, item_type(words.tokenizer.get_vocab_size()))
        for batch in batches:
            for first, ids, bounds in words.runs(batch.column(1)):
                n = len(bounds) - 1
                stream.add(batch.column(0).slice(first, n), np.insert(ids, bounds[1:], end_id), np.diff(bounds) + 1)
                out = stream.take()
                if out.num_rows:
                    yield out
        out = stream.take(rest=True)
        if out.num_rows:
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"ids binary, parts array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>")


def _counts(rows: DataFrame) -> dict[int, int]:
    """Rows of each partition: two numbers a partition reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], ["p", "n"])

    return {r["p"]: r["n"] for r in rows.select(F.lit(0)).mapInArrow(run, "p int, n long").collect()}


WRITTEN = "slot long, shard long, at long, doc_id long, start long, length long, ids_crc32 long"
#: Shards that one task writes, at most.
TASK_SHARDS = 64


def write_shards(docs: DataFrame, out: str, key: int = 1, path: str | None = None, stride: int = STRIDE, shard_size: int = SHARD_SIZE, end_id: int = END_ID, pad_id: int = PAD_ID) -> DataFrame:
    """Write all sequences of ``docs`` to ``out``; a row a part tells where it went. The rows are a written table: reading them again writes nothing."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    path = path or default_path()
    item = item_type(encoder(path).tokenizer.get_vocab_size())
    # The table is written, so its partitions and their rows come in the same order each time.
    rows = scratch.put(sequences(docs, path, stride, end_id), "sequences")
    counts = _counts(rows)
    first, total = {}, 0
    for p in sorted(counts):
        first[p], total = total, total + counts[p]
    order = Feistel(total, key)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        begin = at = first.get(p, 0)
        for b in batches:
            slot = order.slot(np.arange(at, at + b.num_rows))
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(slot), b.column(0), b.column(1)], ["slot", "ids", "parts"])
        if at - begin != counts.get(p, 0):
            raise RuntimeError(f"partition {p} of the token table had {counts.get(p, 0)} sequences when they were counted and has {at - begin} now")

    dealt = rows.mapInArrow(number, f"slot long, {rows._jdf.schema().toDDL()}")
    n_shards = max(1, -(-total // shard_size))
    # Ranges of whole shards. The permutation spreads the slots evenly, so that no range needs to be sampled.
    parts = min(n_shards, max(partitions_of(spark), -(-n_shards // TASK_SHARDS)))
    ranged = dealt.repartitionById(parts, F.floor(F.floor(F.col("slot") / shard_size) * parts / n_shards).cast("int")).sortWithinPartitions("slot")
    width = stride * item.itemsize
    pad = np.full(stride, pad_id, item).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out)
        store.create_dir(root, recursive=True)
        shard, sink, part = None, None, ""

        def close() -> None:
            if sink is not None:
                sink.close()
                store.move(part, f"{root}/{shard:08d}.bin")

        for b in batches:
            raws, slots = b.column(1).to_pylist(), b.column(0).to_numpy()
            for slot, raw in zip(slots.tolist(), raws):
                if slot // shard_size != shard:
                    close()
                    shard, part = slot // shard_size, f"{root}/.{slot // shard_size:08d}.{uuid.uuid4().hex}"
                    sink = store.open_output_stream(part)
                sink.write(raw + pad[: width - len(raw)])
            own = b.column(2).flatten()
            slots = np.repeat(slots, np.diff(b.column(2).offsets.to_numpy()))
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy()))
            at, length = own.field("at").to_numpy(), own.field("length").to_numpy()
            crc = [zlib.crc32(raws[r][x * item.itemsize : (x + n) * item.itemsize]) for r, x, n in zip(row.tolist(), at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(slots // shard_size), pa.array(at), own.field("doc_id"), own.field("start"), pa.array(length), pa.array(crc, pa.int64())], ["slot", "shard", "at", "doc_id", "start", "length", "ids_crc32"])
        close()

    written = scratch.put(ranged.mapInArrow(write, WRITTEN), "written")
    scratch.drop("sequences")
    return written


def read_slots(out: str, start: int, n: int, stride: int = STRIDE, shard_size: int = SHARD_SIZE, item: str = "<u2") -> Iterator[np.ndarray]:
    """The sequences in slots start .. start + n - 1, in training order, read from the shards one after another."""
    store, root = fs.FileSystem.from_uri(out)
    width = stride * np.dtype(item).itemsize
    while n > 0:
        shard, place = divmod(start, shard_size)
        take = min(n, shard_size - place)
        with store.open_input_file(f"{root}/{shard:08d}.bin") as f:
            f.seek(place * width)
            raw = f.read(take * width)
        yield from np.frombuffer(raw, item).reshape(-1, stride)
        start, n = start + take, n - take


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards stay, in a folder of this application beside the scratch tables; a later run replaces them."""
    out = f"{shared_dir(spark)}/token_shards-{spark.sparkContext.applicationId}"
    delete(spark, out)
    return write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), out)
