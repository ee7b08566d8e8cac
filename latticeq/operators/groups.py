"""Groups of linked rows: dense ids, representatives, and splits that keep groups whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .ingest import with_position

SHARES = (0.7, 0.1, 0.2)


def key_edges(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """``a, b``: each row and the first row with its key."""
    first = rows.groupBy(F.col(key).alias("__key")).agg(F.min(pos).alias("a"))
    return rows.join(first, F.col(key) == F.col("__key")).where(F.col(pos) > F.col("a")).select("a", F.col(pos).alias("b"))


def group_roots(rows: DataFrame, edges: DataFrame, pos: str = "pos") -> DataFrame:
    """``pos, root``: the first row of each row's component, over every row."""
    found = components(edges)
    return rows.select(pos).join(found, F.col(pos) == F.col("node"), "left").select(pos, F.coalesce("component", F.col(pos)).alias("root"))


def dense_groups(rooted: DataFrame, pos: str = "pos") -> DataFrame:
    """``pos, group``: components numbered from 0 in the order of their first rows.

    Only roots are numbered, in range partitions with their starts added, not in one task.
    """
    numbers = with_position(rooted.select("root").distinct(), "root").select(F.col("root").alias("__root"), F.col("pos").alias("group"))
    return rooted.join(numbers, F.col("root") == F.col("__root")).select(pos, "group")


def representatives(grouped: DataFrame, pos: str = "pos") -> DataFrame:
    """``grouped`` plus ``is_rep``: the first row of each group stands for it, the others are further photos of it."""
    first = grouped.groupBy(F.col("group").alias("__g")).agg(F.min(pos).alias("__first"))
    return grouped.join(first, F.col("group") == F.col("__g")).withColumn("is_rep", F.col(pos) == F.col("__first")).drop("__g", "__first")


def split_names(rank: Column, n: Column, shares: tuple[float, ...] = SHARES) -> Column:
    """Split of the group at 0-based ``rank`` of ``n``: shares are cut down to whole groups, the rest is test."""
    train, val = F.floor(n * shares[0]), F.floor(n * shares[1])
    return F.when(rank < train, "train").when(rank < train + val, "val").otherwise("test")


def split_groups(groups: DataFrame, seed: int = 0, shares: tuple[float, ...] = SHARES, draw: str = "md5") -> DataFrame:
    """``group, split`` for the distinct groups of ``groups``; a group is in one split only.

    ``draw="md5"`` orders groups by a digest of seed and id; ``draw="numpy"`` permutes the dense ids on the driver
    with numpy's generator, for parity with a seeded permutation.
    """
    distinct = groups.select("group").distinct()
    n = distinct.count()
    if draw == "numpy":
        order = np.random.default_rng(seed).permutation(n)
        train, val = int(shares[0] * n), int(shares[1] * n)
        rows = [(int(g), "train" if k < train else "val" if k < train + val else "test") for k, g in enumerate(order)]
        return groups.sparkSession.createDataFrame(rows, "group bigint, split string")
    keyed = distinct.withColumn("__draw", F.md5(F.concat(F.lit(f"{seed}-"), F.col("group").cast("string"))))
    return with_position(keyed, "__draw", "group").select("group", split_names(F.col("pos"), F.lit(n), shares).alias("split"))
