"""Verification: the ROC curve and what is read from it.

Scores are first counted per value, so that everything after works on distinct scores. Running sums over a total
order are made in range partitions whose starts are added, not in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut

FARS = (1e-2, 1e-3)


def tied_counts(scored: DataFrame, s: str = "s", same: str = "same") -> DataFrame:
    """``s, tp, fp``: genuine and impostor pairs of each distinct score."""
    return scored.groupBy(F.col(s).alias("s")).agg(F.count_if(F.col(same)).alias("tp"), F.count_if(~F.col(same)).alias("fp"))


def curve(scored: DataFrame, s: str = "s", same: str = "same") -> DataFrame:
    """``k, s, tp, fp, last_tp, last_fp, n_pos, n_neg``: cumulative counts by falling score, ``k`` from 1.

    The point (0, 0) before the first has no row; :func:`corners` adds it.
    """
    counts = cut(tied_counts(scored, s, same).repartitionByRange(F.desc("s")).withColumn("__part", F.spark_partition_id()))
    sums = counts.groupBy("__part").agg(F.sum("tp").alias("t"), F.sum("fp").alias("f"), F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sums.select("__part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in "tfn"), F.sum("t").over(every).alias("n_pos"), F.sum("f").over(every).alias("n_neg"))
    inside = Window.partitionBy("__part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.join(F.broadcast(starts), "__part")
    tp, fp = F.col("__t") + F.sum("tp").over(inside), F.col("__f") + F.sum("fp").over(inside)
    return run.select((F.col("__n") + F.row_number().over(Window.partitionBy("__part").orderBy(F.desc("s")))).alias("k"), "s", tp.alias("tp"), fp.alias("fp"), F.col("tp").alias("own_tp"), F.col("fp").alias("own_fp"), "n_pos", "n_neg")


def auc(points: DataFrame) -> DataFrame:
    """Area under the curve: trapezoids between tied scores, so that ties count half."""
    area = F.col("own_fp") * (F.col("tp") - F.col("own_tp") / F.lit(2.0))
    return points.agg((F.sum(area) / (F.max("n_pos").cast("double") * F.max("n_neg"))).alias("auc"))


def corners(points: DataFrame) -> DataFrame:
    """``k, s, tp, fp, n_pos, n_neg`` with the point (0, 0) at infinity and without points inside a straight stretch.

    A point is inside one if the step to it and the step after it are equal.
    """
    n = points.select("n_pos", "n_neg").limit(1)
    start = n.select(F.lit(0).cast("bigint").alias("k"), F.lit(float("inf")).alias("s"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"), "n_pos", "n_neg")
    step = points.select(F.col("k"), F.col("own_tp"), F.col("own_fp"))
    after = step.select((F.col("k") - 1).alias("k"), F.col("own_tp").alias("next_tp"), F.col("own_fp").alias("next_fp"))
    kept = points.join(after, "k", "left").where(F.col("next_tp").isNull() | (F.col("next_tp") != F.col("own_tp")) | (F.col("next_fp") != F.col("own_fp")))
    return start.unionByName(kept.select("k", "s", "tp", "fp", "n_pos", "n_neg"))


def rates(c: DataFrame) -> DataFrame:
    return c.withColumn("tpr", F.col("tp") / F.col("n_pos")).withColumn("fpr", F.col("fp") / F.col("n_neg"))


def equal_error(c: DataFrame) -> DataFrame:
    """``eer, threshold`` at the first point where misses and false accepts are closest."""
    r = rates(c).withColumn("fnr", 1 - F.col("tpr"))
    best = F.min_by(F.struct("fnr", "fpr", "s"), F.struct(F.abs(F.col("fnr") - F.col("fpr")), F.col("k")))
    return r.agg(best.alias("p")).select(((F.col("p.fnr") + F.col("p.fpr")) / 2).alias("eer"), F.col("p.s").alias("threshold"))


def accept_at(c: DataFrame, fars: tuple[float, ...] = FARS) -> DataFrame:
    """Greatest true-accept rate at each false-accept rate; 0 if no point is within it."""
    r = rates(c)
    return r.agg(*(F.coalesce(F.max(F.when(F.col("fpr") <= far, F.col("tpr"))), F.lit(0.0)).alias(f"tar_{k}") for k, far in enumerate(fars)))


def at_threshold(scored: DataFrame, tau: Column, s: str = "s", same: str = "same") -> DataFrame:
    """Accuracy, true and false accept rates at a threshold (inclusive), and the counts."""
    said = F.col(s) >= tau
    return scored.agg(
        F.avg((said == F.col(same)).cast("double")).alias("acc"),
        F.avg(F.when(F.col(same), said.cast("double"))).alias("tar"),
        F.avg(F.when(~F.col(same), said.cast("double"))).alias("far"),
        F.count_if(F.col(same)).alias("n_genuine"),
        F.count_if(~F.col(same)).alias("n_impostor"),
    )
