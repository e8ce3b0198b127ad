"""Classification metrics. All but the ranked curves come from one (true, predicted) count table of C^2 rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import validation as V
from ..functions.lineage import checkpointed


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def accuracy(df: DataFrame, y: str, p: str, normalize: bool = True) -> DataFrame:
    hit = (F.col(y) == F.col(p)).cast("double")
    return df.agg((F.avg(hit) if normalize else F.sum(hit)).alias("accuracy"))


def zero_one_loss(df: DataFrame, y: str, p: str, normalize: bool = True) -> DataFrame:
    miss = (F.col(y) != F.col(p)).cast("double")
    return df.agg((F.avg(miss) if normalize else F.sum(miss)).alias("loss"))


def binary_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: tp, tn, fp, fn of labels 0 and 1."""
    t, q = F.col(y) == 1, F.col(p) == 1
    n = lambda c: F.count_if(c)
    return df.agg(n(t & q).alias("tp"), n(~t & ~q).alias("tn"), n(~t & q).alias("fp"), n(t & ~q).alias("fn"))


def binary_precision(df: DataFrame, y: str, p: str) -> DataFrame:
    return binary_counts(df, y, p).select(_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def binary_recall(df: DataFrame, y: str, p: str) -> DataFrame:
    return binary_counts(df, y, p).select(_ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


binary_sensitivity = binary_recall


def binary_specificity(df: DataFrame, y: str, p: str) -> DataFrame:
    return binary_counts(df, y, p).select(_ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"))


def mcc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Matthews correlation of labels 0 and 1: -1 if nothing is right, 0 without a denominator."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    den = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    score = F.when((tp == 0) & (tn == 0), -1.0).when(den == 0, 0.0).otherwise((tp * tn - fp * fn) / F.sqrt(den))
    return binary_counts(df, y, p).select(score.alias("mcc"))


def confusion_counts(df: DataFrame, y: str, p: str, weight: str | None = None) -> DataFrame:
    """(t, q, n): weighted counts of the pairs that occur. Pre-aggregated: a skewed class shuffles one row a task."""
    return df.groupBy(F.col(y).alias("t"), F.col(p).alias("q")).agg(F.sum(V.weight_column(weight)).alias("n"))


def confusion_matrix(df: DataFrame, y: str, p: str, num_classes: int, weight: str | None = None, normalize: str | bool | None = None) -> DataFrame:
    """(t, q, n) of all pairs of classes; normalised over true (True), "predicted" or "all"."""
    spark = df.sparkSession
    cells = spark.range(num_classes * num_classes).select((F.col("id") / num_classes).cast("int").alias("t"), (F.col("id") % num_classes).cast("int").alias("q"))
    full = cells.join(confusion_counts(df, y, p, weight), ["t", "q"], "left").select("t", "q", F.coalesce("n", F.lit(0.0)).alias("n"))
    if normalize is None or normalize is False:
        return full
    w = {True: W.partitionBy("t"), "true": W.partitionBy("t"), "predicted": W.partitionBy("q"), "all": W.partitionBy(F.lit(0))}[normalize]
    return full.withColumn("n", _ratio(F.col("n"), F.sum("n").over(w)))


def _per_class(df: DataFrame, y: str, p: str, num_classes: int) -> DataFrame:
    """(label, tp, fp, fn, tn) of each class against the rest, in one pass over the rows."""
    c = confusion_counts(df, y, p)
    parts = c.select(F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("q"), F.col("n")).otherwise(0.0).alias("tp"), F.lit(0.0).alias("fp"), F.when(F.col("t") != F.col("q"), F.col("n")).otherwise(0.0).alias("fn")),
        F.struct(F.col("q").alias("label"), F.lit(0.0).alias("tp"), F.when(F.col("t") != F.col("q"), F.col("n")).otherwise(0.0).alias("fp"), F.lit(0.0).alias("fn")),
    )).alias("s"), "n", (F.col("t") == F.col("q")).alias("same")).select("s.*")
    own = parts.groupBy("label").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    labels = df.sparkSession.range(num_classes).select(F.col("id").cast("int").alias("label"))
    full = labels.join(own, "label", "left").select("label", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("tp", "fp", "fn")])
    everything = F.sum(F.col("tp") + F.col("fn")).over(W.partitionBy(F.lit(0)))
    return full.withColumn("tn", everything - F.col("tp") - F.col("fp") - F.col("fn"))


def precision(df: DataFrame, y: str, p: str, num_classes: int) -> DataFrame:
    return _per_class(df, y, p, num_classes).select("label", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def recall(df: DataFrame, y: str, p: str, num_classes: int) -> DataFrame:
    return _per_class(df, y, p, num_classes).select("label", _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


sensitivity = recall


def specificity(df: DataFrame, y: str, p: str, num_classes: int) -> DataFrame:
    return _per_class(df, y, p, num_classes).select("label", _ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"))


def balanced_accuracy_score(df: DataFrame, y: str, p: str, num_classes: int, adjusted: bool = False) -> DataFrame:
    """Mean recall over the classes that occur; ``adjusted`` takes chance out."""
    present = _per_class(df, y, p, num_classes).where("tp + fn > 0").agg(F.avg(F.col("tp") / (F.col("tp") + F.col("fn"))).alias("s"), F.count(F.lit(1)).alias("k"))
    score = F.col("s")
    if adjusted:
        score = (score - 1 / F.col("k")) / (1 - 1 / F.col("k"))
    return present.select(score.alias("balanced_accuracy"))


def _fbeta(prec: Column, rec: Column, beta: float) -> Column:
    if beta == float("inf"):
        return rec
    b = float(beta) ** 2
    return _ratio((1 + b) * prec * rec, b * prec + rec) if beta else prec


def precision_recall_fscore_support(df: DataFrame, y: str, p: str, num_classes: int, beta: float = 1.0, average: str = "none") -> DataFrame:
    """(label, precision, recall, fscore, support).

    "micro" gives one row. "macro" and "weighted" average the F-score alone: precision and recall stay a
    row a class, with the average beside each and NaN as support.
    """
    V.one_of(average, ("none", "micro", "macro", "weighted"))
    V.beta(beta)
    c = _per_class(df, y, p, num_classes)
    if average == "micro":
        c = c.agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    prec, rec = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    label = [] if average == "micro" else ["label"]
    out = c.select(*label, prec.alias("precision"), rec.alias("recall"), (F.col("tp") + F.col("fn")).alias("support"))
    out = out.withColumn("fscore", _fbeta(F.col("precision"), F.col("recall"), beta))
    if average in ("macro", "weighted"):
        w = W.partitionBy(F.lit(0))
        mean = F.avg("fscore").over(w) if average == "macro" else _ratio(F.sum(F.col("fscore") * F.col("support")).over(w), F.sum("support").over(w))
        out = out.withColumn("fscore", mean).withColumn("support", F.lit(float("nan")))
    return out.select(*label, "precision", "recall", "fscore", "support")


def fbeta_score(df: DataFrame, y: str, p: str, beta: float, num_classes: int, average: str = "none") -> DataFrame:
    out = precision_recall_fscore_support(df, y, p, num_classes, beta, average)
    if average in ("macro", "weighted"):
        return out.agg(F.max("fscore").alias("fscore"))
    return out.select(*[c for c in ("label",) if c in out.columns], "fscore")


def f1_score(df: DataFrame, y: str, p: str, num_classes: int, average: str = "none") -> DataFrame:
    return fbeta_score(df, y, p, 1.0, num_classes, average)


def cohen_kappa_score(df: DataFrame, y1: str, y2: str, num_classes: int, weight: str | None = None, weighting: str | None = None) -> DataFrame:
    """Agreement beyond chance; disagreements count 1, or by "linear" or "quadratic" distance of the classes."""
    c = confusion_matrix(df, y1, y2, num_classes, weight)
    far = F.abs(F.col("t") - F.col("q")).cast("double")
    cost = {None: (F.col("t") != F.col("q")).cast("double"), "linear": far, "quadratic": far * far}[weighting]
    rows, cols, whole = (F.sum("n").over(W.partitionBy(k)) for k in ("t", "q", F.lit(0)))
    s = c.withColumns({"expected": rows * cols / whole, "cost": cost})
    return s.agg((1 - F.sum(F.col("cost") * F.col("n")) / F.sum(F.col("cost") * F.col("expected"))).alias("kappa"))


def brier_score_loss(df: DataFrame, y: str, prob: str, pos_label: int = 1, weight: str | None = None) -> DataFrame:
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(prob).cast("double")))
    miss = (F.col(y) == pos_label).cast("double") - p
    w = V.weight_column(weight)
    return df.agg((F.sum(w * miss * miss) / F.sum(w)).alias("brier"))


def log_loss(df: DataFrame, y: str, proba: str, weight: str | None = None, normalize: bool = True) -> DataFrame:
    """``proba`` is an array, ``y`` an index into it; a probability of 0 costs infinity."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.element_at(proba, F.col(y).cast("int") + 1)))
    cost = F.when(p == 0, F.lit(float("inf"))).otherwise(-F.log(p))
    w = V.weight_column(weight)
    total = F.sum(w * cost)
    return df.agg((total / F.sum(w) if normalize else total).alias("log_loss"))


def top_k_accuracy_score(df: DataFrame, y: str, scores: str, k: int = 5, normalize: bool = True) -> DataFrame:
    """``scores``: an array a row, ties to the lower class; or, of two classes, the score of class 1 (k of 1: over 0.5; k of 2 or more: always right)."""
    if dict(df.dtypes)[scores].startswith("array"):
        own = F.element_at(scores, F.col(y).cast("int") + 1)
        ahead = F.size(F.filter(F.transform(F.col(scores), lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: (x["s"] > own) | ((x["s"] == own) & (x["i"] < F.col(y)))))
        hit = ahead < k
    else:
        hit = F.lit(True) if k >= 2 else (F.col(scores) > 0.5).cast("int") == F.col(y)
    hit = hit.cast("double")
    return df.agg((F.avg(hit) if normalize else F.sum(hit)).alias("top_k_accuracy"))


# Ranked curves.
#
# A window over all rows would put them in one task. Rows are summed a distinct score first, once; these
# are dealt by ranges of falling score and kept, and running sums are taken within ranges side by side, from
# what the ranges before hold (a row a range reaches the driver).


def score_groups(df: DataFrame, y: str, score: str, weight: str | None = None) -> DataFrame:
    """(score, p, n, tps, fps): weight of positives and negatives at this score, and at this score or above; a row a distinct score."""
    w = V.weight_column(weight)
    pos = (F.col(y) == 1).cast("double")
    g = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.coalesce(F.sum(w * pos), F.lit(0.0)).alias("p"), F.coalesce(F.sum(w * (1 - pos)), F.lit(0.0)).alias("n"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = checkpointed(g.repartitionByRange(ranges, F.desc("score")).sortWithinPartitions(F.desc("score")).withColumn("part", F.spark_partition_id()))
    sums = sorted(map(tuple, g.groupBy("part").agg(F.sum("p"), F.sum("n")).collect()))
    before, p0, n0 = {}, 0.0, 0.0
    for part, p, n in sums:
        before[part] = (p0, n0)
        p0, n0 = p0 + p, n0 + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for b in batches:
            if not b.num_rows:
                continue
            p, n, part = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            done = before[int(part[0])] if done is None else done
            tps, fps = done[0] + np.cumsum(p), done[1] + np.cumsum(n)
            done = (tps[-1], fps[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(tps), pa.array(fps)], ["score", "p", "n", "tps", "fps"])

    return g.mapInArrow(run, "score double, p double, n double, tps double, fps double")


def distinct_values(df: DataFrame, score: str) -> DataFrame:
    """The thresholds of the ranked curves."""
    return df.select(F.col(score).cast("double").alias("threshold")).distinct()


def _ends(g: DataFrame) -> dict[str, float]:
    r = g.agg(F.max("tps").alias("p"), F.max("fps").alias("n"), F.max("score").alias("top")).first()
    return {"p": r["p"] or 0.0, "n": r["n"] or 0.0, "top": r["top"]}


def roc_curve(df: DataFrame, y: str, score: str, weight: str | None = None) -> DataFrame:
    """(fpr, tpr, threshold), with the point (0, 0) at the highest score + 1."""
    g = score_groups(df, y, score, weight)
    e = _ends(g)
    points = g.select((F.col("fps") / F.lit(e["n"])).alias("fpr") if e["n"] else F.lit(float("nan")).alias("fpr"), (F.col("tps") / F.lit(e["p"])).alias("tpr") if e["p"] else F.lit(float("nan")).alias("tpr"), F.col("score").alias("threshold"))
    return points.unionByName(df.sparkSession.createDataFrame([(0.0, 0.0, (e["top"] or 0.0) + 1.0)], "fpr double, tpr double, threshold double"))


def precision_recall_curve(df: DataFrame, y: str, score: str, weight: str | None = None) -> DataFrame:
    """(precision, recall, threshold), with the point (1, 0) without a threshold."""
    g = score_groups(df, y, score, weight)
    p = _ends(g)["p"]
    points = g.select(_ratio(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"), (F.col("tps") / F.lit(p) if p else F.lit(1.0)).alias("recall"), F.col("score").alias("threshold"))
    return points.unionByName(df.sparkSession.createDataFrame([(1.0, 0.0, None)], "precision double, recall double, threshold double"))


def det_curve(df: DataFrame, y: str, score: str, weight: str | None = None) -> DataFrame:
    """(fpr, fnr, threshold)."""
    g = score_groups(df, y, score, weight)
    e = _ends(g)
    return g.select((F.col("fps") / F.lit(e["n"] or 1.0)).alias("fpr"), (1 - F.col("tps") / F.lit(e["p"] or 1.0)).alias("fnr"), F.col("score").alias("threshold"))


def roc_auc_score(df: DataFrame, y: str, score: str, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve: positives over negatives, ties half, as a sum over the distinct scores alone."""
    g = score_groups(df, y, score, weight)
    e = _ends(g)
    if not e["p"] or not e["n"]:
        return df.sparkSession.createDataFrame([(float("nan"),)], "auc double")
    area = F.col("n") * (F.col("tps") - F.col("p") / 2)
    return g.agg((F.sum(area) / F.lit(e["p"] * e["n"])).alias("auc"))


def average_precision_score(df: DataFrame, y: str, score: str, weight: str | None = None) -> DataFrame:
    """Sum of precision times the step in recall."""
    g = score_groups(df, y, score, weight).where("p > 0")
    return g.agg(F.coalesce(F.sum(F.col("p") * F.col("tps") / (F.col("tps") + F.col("fps"))) / F.sum("p"), F.lit(0.0)).alias("average_precision"))


def auc(df: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    """Area by trapezoids in the order of ``x``; curves of their own a ``group``.

    Points that share an x stand in the order of y, and take no area. Null if there are fewer than two.
    """
    if not group:
        from .integrate import whole_area

        few = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).limit(2).count() < 2
        return df.sparkSession.createDataFrame([(None if few else whole_area(df, x, y),)], "auc double")
    w = W.partitionBy(*group).orderBy(x, y)
    step = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.select(*group, step.alias("a")).groupBy(*group).agg(F.sum("a").alias("auc"))
