"""Connected components of a distributed edge table by alternating large-star and small-star steps.

(R. Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.) Every round is cut in the shared
checkpoint folder; no links and no labels reach the driver, only a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut, release


def _toward_least(edges: DataFrame) -> DataFrame:
    """Large-star: each node links its greater neighbours to the least node it knows, itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Small-star: each node links its smaller neighbours, and itself, to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
    other = edges.join(least, F.col("a") == F.col("node")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return other.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """``node, component``: the least node reachable, for every node of an edge between two different nodes.

    Edges may repeat and come in either direction; null ends and loops link nothing. With ``rounds`` it stops after
    so many: nodes of one component may then have different marks, but a mark still joins linked nodes only.
    """
    edges = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    edges, mark = cut(edges.distinct()), None
    for _ in range(rounds or 0):
        edges = cut(_small(_toward_least(edges)))
    while rounds is None:
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % F.lit(1_000_003)), F.lit(0))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        edges = cut(_small(_toward_least(edges)))
        release(edges.sparkSession)
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("node")).distinct().join(least.select("node"), "node", "left_anti")
    return least.unionByName(roots.withColumn("component", F.col("node")))
