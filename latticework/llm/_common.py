"""Shared plumbing of the training-data operators: scratch tables, Arrow helpers, components."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CREATED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or else the checkpoint folder set on the context.

    Where neither is set, a local master, all in one machine, gets a folder of its own; a cluster is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/latticework-scratch"
    return base.rstrip("/")


class Scratch:
    """Tables of one operator run, written as Parquet so that a lost executor costs no recomputation.

    ``put`` writes and rereads a table, ``drop`` deletes one that no later plan reads. Tables that a
    returned (lazy) DataFrame still reads go when the interpreter ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lw-{uuid.uuid4().hex}"
        _CREATED[self.root] = spark

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Let Spark delete the shuffle files of steps whose results are written. It does so when the driver's
        garbage is collected, which may otherwise take longer than a run; the last query is held until the next."""
        gc.collect()
        self.spark.range(1).write.format("noop").mode("overwrite").save()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _cleanup() -> None:
    for root, spark in _CREATED.items():
        try:
            delete(spark, root)
        except Exception:  # the session may be gone already
            pass


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


class Store:
    """Values of recurring keys (texts or bytes), a process; ``limit`` bounds their bytes in all, whatever the corpus.

    An entry counts its key, its value and EACH for the objects around them. When it is full, all goes but the values of the keys at hand, as far as they fit.
    """

    EACH = 200

    def __init__(self, limit: int):
        self.limit, self.size, self.kept = limit, 0, {}

    def look(self, keys: list, make: Callable[[list], dict], size: Callable = len) -> list:
        """The values of distinct ``keys``; ``make`` gives those that aren't there."""
        kept = self.kept
        new = [k for k in keys if k not in kept]
        made = make(new) if new else {}
        out = [kept[k] if k in kept else made[k] for k in keys]
        more = sum(len(k) + size(made[k]) + Store.EACH for k in new)
        if self.size + more > self.limit:
            kept.clear()
            self.size, more, made = 0, 0, {}
            for k, v in zip(keys, out):
                if (more := more + len(k) + size(v) + Store.EACH) > self.limit:
                    break
                made[k] = v
                self.size = more
            more = 0
        kept.update(made)
        self.size += more
        return out


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def free_name(taken: list[str], name: str) -> str:
    """A column name like ``name`` that clashes with none of ``taken``, whatever their case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(scratch: Scratch, edges: DataFrame, name: str = "cc", max_rounds: int = 200) -> DataFrame:
    """Smallest reachable id of every node of ``edges`` (a long, b long): rows (node, component).

    First, a node's edges to smaller nodes become one to the smallest of these, from which edges lead to
    the others: the same connections, with few edges more than nodes. Each round then takes, a node, the
    least label of itself and its neighbours: a join and a minimum that is taken before the shuffle. From
    the third round on, labels are also replaced by their own labels, so that long chains take a logarithmic
    number of rounds. No node's neighbours are gathered in a task; the joins' hot keys can be split. Each
    round is a written table.
    """
    down = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = scratch.put(down.groupBy("a").agg(F.min("b").alias("m")), f"{name}_least")
    edges = least.select("a", F.col("m").alias("b")).unionAll(down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
    both = scratch.put(both, f"{name}_edges")
    labels = scratch.put(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")), f"{name}_0")
    state = None
    for k in range(1, max_rounds + 1):
        offered = both.join(labels.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "component")
        new = scratch.put(offered.unionAll(labels).groupBy("node").agg(F.min("component").alias("component")), f"{name}_{k}")
        if k >= 3:
            labels_of = new.select(F.col("node").alias("component"), F.col("component").alias("further"))
            new = scratch.put(new.join(labels_of, "component").select("node", F.col("further").alias("component")), f"{name}_{k}j")
        now = new.agg(F.count(F.lit(1)), F.sum(F.col("component").cast("decimal(20,0)"))).first()
        scratch.drop(f"{name}_{k - 1}", f"{name}_{k - 1}j", *([f"{name}_{k}"] if k >= 3 else []))
        if now == state:
            break
        state, labels = now, new
    else:
        raise RuntimeError(f"connected components did not converge in {max_rounds} rounds")
    scratch.drop(f"{name}_edges", f"{name}_least")
    return new
