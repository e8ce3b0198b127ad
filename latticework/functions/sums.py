"""Sums of arrays in two levels: tasks sum what they read, a few tasks sum those, and the driver the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tasks of the second level: so many rows a group reach the driver, whatever the number of partitions.
FAN = 16


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(ends - ends[0], ends[1:] - ends[0]):
        yield flat[a:b]


def array_sums(parts: DataFrame) -> dict[object, np.ndarray]:
    """Of rows (g, s: array of double), the sum of the arrays of each g. Arrays of one g are equally long."""
    kind = parts.schema["g"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, np.ndarray] = {}
        g = None
        for b in batches:
            g = b.column(0).type
            for key, s in zip(b.column(0).to_pylist(), _arrays(b.column(1))):
                sums[key] = sums[key] + s if key in sums else s.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), g), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["g", "s"])

    out: dict[object, np.ndarray] = {}
    for r in parts.repartition(FAN).mapInArrow(run, f"g {kind}, s array<double>").collect():
        out[r["g"]] = out.get(r["g"], 0) + np.array(r["s"])
    return out


def total(table: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], partitions: int | None = None) -> np.ndarray:
    """Sum of ``part(batch)`` over the Arrow batches of ``table``.

    ``partitions``: how many ``table`` has, where that is known; as few as FAN need no second level.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = None
        for b in batches:
            if b.num_rows:
                own = part(b).ravel()
                s = own if s is None else s + own
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([s], pa.list_(pa.float64()))], ["g", "s"])

    parts = table.mapInArrow(run, "g int, s array<double>")
    if partitions is not None and partitions <= FAN:
        return np.sum([np.array(r["s"]) for r in parts.collect()], axis=0)
    return array_sums(parts).get(0, np.zeros(0))
