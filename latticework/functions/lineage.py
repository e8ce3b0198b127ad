"""Cutting lineage where executors can be lost."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the reliable checkpoint folder.

    The folder is the context's, else ``spark.checkpoint.dir``. Where neither is set, a local master, all in
    one machine, gets a folder of its own; a cluster is an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='latticework-')}"
        context.setCheckpointDir(folder)
    return df.checkpoint()
