"""The benchmark's protocols over one table of specifications and one of their vectors.

Gallery: one row a design. P1 color changes by family; P2 traps (a design in another's palette); P3 shared palettes
(both sides of a round); P4 further photos; and verification of pairs. Vectors are read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from . import ranking, roc, specs

LONG = ("protocol", "family", "metric", "value")


def long_form(metrics: DataFrame, protocol: Column, family: Column, names: list[str]) -> DataFrame:
    """Rows ``protocol, family, metric, value`` of a wide table."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names)))
    return metrics.select(protocol.alias("protocol"), family.alias("family"), pairs.alias("m")).select("protocol", "family", "m.metric", "m.value")


def _side(spec: DataFrame, vectors: DataFrame, p: str, *carried: str) -> DataFrame:
    rows = spec.select(F.col("spec_id").alias(p), F.col("label").alias(f"{p}_label"), *carried)
    return rows.join(vectors.select(F.col("spec_id").alias(p), F.col("embedding").alias(f"{p}_vec")), p)


def protocols(spec: DataFrame, pairs: DataFrame, vectors: DataFrame, tau: float | None = None) -> DataFrame:
    """All metrics as ``protocol, family, metric, value``; P4 is there only if there are further photos.

    ``spec`` and ``pairs`` come from :mod:`latticeq.operators.specs`, ``vectors`` has ``spec_id`` and ``embedding``
    (normalised). Queries are ranked once; families, classes and all come from one roll-up.
    """
    vectors = cut(vectors.select("spec_id", "embedding"))
    gallery = _side(spec.where("role = 'gallery'"), vectors, "g")
    queries = _side(spec.where("role IN ('p1', 'trap', 'rephoto')"), vectors, "q", "role", "family", "donor_label")
    ranked = cut(ranking.ranked(queries, gallery, by=("q", "q_label", "role", "family", "donor_label")))
    names = ["r1", "r5", "r10", "map", "n_queries"]

    p1 = ranked.where("role = 'p1'").withColumn("family_class", F.when(F.col("family").isin(*specs.HELD_OUT_FAMILIES), "heldout").otherwise("train"))
    label = F.coalesce("family", "family_class", F.lit("all"))
    out = [long_form(ranking.rolled_up(p1, "family", "family_class"), F.lit("P1"), label, names)]
    trap = ranking.identification(ranked.where("role = 'trap'"), donor="donor_label")
    out.append(long_form(trap, F.lit("P2"), F.lit("trap"), ["r1", "r5", "r10", "map", "trap1", "n_queries"]))
    photos = ranking.identification(ranked.where("role = 'rephoto'"), by=("role",))
    out.append(long_form(photos, F.lit("P4"), F.col("role"), names))

    shared = spec.where("role = 'shared'")
    for_round = []
    for r in range(specs.SHARED_ROUNDS):
        own = shared.where(F.col("round") == r)
        met = ranking.ranked(_side(own.where("aug"), vectors, "q", "round"), _side(own.where("NOT aug"), vectors, "g"), by=("q", "q_label", "round"))
        for_round.append(ranking.identification(met, by=("round",)))
    mean = reduce(DataFrame.unionByName, for_round).agg(*(F.avg(n).alias(n) for n in names))
    out.append(long_form(mean, F.lit("P3"), F.lit("shared"), names))

    scored = cut(ranking.pair_scores(pairs, vectors.select(F.col("spec_id").alias("id"), F.col("embedding").alias("vec"))).withColumn("same", F.col("kind") == "genuine"))
    for name, rows in (("all", scored), ("samepalette", scored.where("kind <> 'impostor_random'"))):
        points = roc.curve(rows.select("s", "same"))
        corner = cut(roc.corners(points))
        found = roc.auc(points).crossJoin(roc.equal_error(corner)).crossJoin(roc.accept_at(corner))  # one row each
        out.append(long_form(found, F.lit("verification"), F.lit(name), ["auc", "eer", "threshold", "tar_0", "tar_1"]))
        if tau is not None:
            out.append(long_form(roc.at_threshold(rows, F.lit(tau)), F.lit("verification"), F.lit(name), ["acc", "tar", "far", "n_genuine", "n_impostor"]))
    stats = scored.groupBy("kind").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"))
    out.append(long_form(stats, F.lit("scores"), F.col("kind"), ["mean", "std"]))
    return reduce(DataFrame.unionByName, out)


def value_of(metrics: DataFrame, protocol: str, family: str, metric: str) -> Column:
    return F.max(F.when((F.col("protocol") == protocol) & (F.col("family") == family) & (F.col("metric") == metric), F.col("value")))


#: Name in the report: protocol, family and metric.
HEADLINE = {
    "p1_r1": ("P1", "all", "r1"),
    "p1_map": ("P1", "all", "map"),
    "p1_train_r1": ("P1", "train", "r1"),
    "p1_heldout_r1": ("P1", "heldout", "r1"),
    "p2_r1": ("P2", "trap", "r1"),
    "p2_trap1": ("P2", "trap", "trap1"),
    "p3_r1": ("P3", "shared", "r1"),
    "p4_r1": ("P4", "rephoto", "r1"),
    "auc": ("verification", "all", "auc"),
    "eer": ("verification", "all", "eer"),
    "tar_at_far_01": ("verification", "all", "tar_0"),
    "samepalette_auc": ("verification", "samepalette", "auc"),
    "acc": ("verification", "all", "acc"),
}


def headline(metrics: DataFrame) -> DataFrame:
    """One row of the numbers that a report leads with; null where a protocol did not run."""
    return metrics.agg(*(value_of(metrics, *at).alias(name) for name, at in HEADLINE.items()))


def selection_score(head: DataFrame) -> DataFrame:
    """Mean first-rank recall of the three protocols by which checkpoints are chosen."""
    return head.select(((F.col("p1_r1") + F.col("p2_r1") + F.col("p3_r1")) / 3).alias("val_score"))


def calibrated(val: tuple[DataFrame, DataFrame, DataFrame], test: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[float, DataFrame]:
    """Threshold from the validation designs, metrics of the test designs at it; each is ``(spec, pairs, vectors)``."""
    found = protocols(*val)
    tau = found.agg(value_of(found, "verification", "all", "threshold").alias("t")).first()["t"]
    return tau, protocols(*test, tau=tau)
