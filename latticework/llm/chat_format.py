"""Chat formatting with a collapse of cumulative snapshots.

Chat logs often hold a conversation once for each of its turns. Every conversation's turns are hashed
in a row, so that there is a name for each prefix of it. A conversation whose whole name is also the
name of a proper prefix of another one is a snapshot: an anti-join takes it out. Of equal
conversations the smallest conv_id stays. What is left is rendered.

Turns stand in the order of (turn, role, text), nulls first; the turn numbers themselves are not
compared. Defined results: rows equal in all four columns are one turn; rows with a null conv_id form
no conversation; a null role renders as ``unknown`` and a null text as empty, but neither is equal to
these; other columns are not carried. A conversation is one output row, so its turns fit in one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, map_batches

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (turn, role, text) in order)."""
    rows = turns.where("conv_id is not null").select("conv_id", F.struct("turn", "role", "text").alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def prefix_names(convs: DataFrame) -> DataFrame:
    """(conv_id, k, n, p1, p2): the 128-bit name of the first k of a conversation's n turns."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, ks, ns, names = [], [], [], []
        for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            chain = hashlib.blake2b(digest_size=16)
            for k, t in enumerate(turns):
                for part in (t["role"], t["text"]):
                    raw = (part or "").encode()
                    chain.update(b"-" if part is None else b"%d:" % len(raw) + raw)
                ids.append(conv)
                ks.append(k + 1)
                ns.append(len(turns))
                names.append(chain.copy().digest())
        p = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(ks, pa.int64()), pa.array(ns, pa.int64()), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["conv_id", "k", "n", "p1", "p2"])

    kind = dict(convs.dtypes)["conv_id"]
    return map_batches(convs.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")), run, f"conv_id {kind}, k long, n long, p1 long, p2 long")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of the conversations that are no snapshot of another and no later copy of one."""
    scratch = Scratch(turns.sparkSession)
    convs = scratch.put(conversations(turns), "conversations")
    names = scratch.put(prefix_names(convs), "names")
    whole = names.where("k = n").groupBy("p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    longer = names.where("k < n").select("p1", "p2").distinct()
    kept = scratch.put(whole.join(longer, ["p1", "p2"], "left_anti").select("conv_id"), "kept")
    return convs.join(kept, "conv_id", "left_semi")


def render(convs: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text)."""
    turn = lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE + "\n"))
    return convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", turn), "").alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Collapse, then render."""
    return render(maximal(turns))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "n_turns", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, list(md5(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1))) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS h,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS r
  FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT md5(array_to_string(h[1:k], '')) AS q FROM c, unnest(generate_series(1, n - 1)) AS g(k)),
w AS (SELECT min(conv_id) AS conv_id FROM c GROUP BY md5(array_to_string(h, '')) HAVING md5(array_to_string(h, '')) NOT IN (SELECT q FROM p))
SELECT conv_id, n::BIGINT AS n_turns, length(r)::BIGINT AS n_chars, sha256(r) AS text_sha256 FROM c JOIN w USING (conv_id)
"""
