"""Models that follow a stream: each micro-batch is summed by Spark, and what is kept is of fixed size."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.decomposition import PCA, PCAModel
from ..operators.stats import gram


@dataclass
class IncrementalPCA:
    """``update`` is for foreachBatch. A batch that is delivered again is counted once."""

    cols: list[str]
    num_components: int
    whiten: bool = False
    model: PCAModel | None = None
    last_batch: int = -1

    def update(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last_batch or batch.isEmpty():
            return
        if self.model is None:
            self.model = PCA.fit(batch, self.cols, self.num_components, self.whiten)
        else:
            self.model = PCA.partial_fit(self.model, batch)
        self.last_batch = batch_id

    def follow(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


@dataclass
class IncrementalMoments:
    """Count, means and covariances of all rows so far."""

    cols: list[str]
    n: int = 0
    mean: np.ndarray | None = None
    scatter: np.ndarray | None = field(default=None, repr=False)
    last_batch: int = -1

    def update(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last_batch or batch.isEmpty():
            return
        s = gram(batch, self.cols)[None]
        own = s.covariance() * s.weight
        if self.mean is None:
            self.n, self.mean, self.scatter = s.n, s.mean, own
        else:
            shift, n = s.mean - self.mean, self.n + s.n
            self.scatter = self.scatter + own + np.outer(shift, shift) * (self.n * s.n / n)
            self.mean, self.n = self.mean + shift * (s.n / n), n
        self.last_batch = batch_id

    def covariance(self) -> np.ndarray:
        return self.scatter / self.n


def windowed(stream: DataFrame, time: str, value: str, keys: list[str], width: str, slide: str | None = None, late: str = "10 minutes", aggregates: dict[str, Callable] | None = None) -> DataFrame:
    """Count, mean and deviation a key and time window; rows later than ``late`` are left out, windows end with the watermark."""
    aggregates = aggregates or {"n": F.count, "mean": F.avg, "deviation": F.stddev_pop}
    w = F.window(time, width, slide) if slide else F.window(time, width)
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    grouped = stream.withWatermark(time, late).groupBy(w.alias("window"), *keys)
    return grouped.agg(*[fn(value).alias(name) for name, fn in aggregates.items()]).select("window.start", "window.end", *keys, *aggregates)
