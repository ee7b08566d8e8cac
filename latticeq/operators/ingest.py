"""Ingest: classify entries, drop unusable and repeated ones with a count of each, and name their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut

STATUS = ("kept", "bad", "small", "dup")
MIN_SIDE = 96
LEAST_ROWS = 10


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """``wanted``, each with underscores before it until no column has that name (ignoring case)."""
    lower = {c.lower() for c in taken}
    return ["_" * next(k for k in range(len(lower) + 1) if "_" * k + w.lower() not in lower) + w for w in wanted]


def classify(entries: DataFrame, digest: Column, side: Column, usable: Column, order: Column, min_side: int = MIN_SIDE) -> DataFrame:
    """``entries`` plus ``status``.

    An entry is a duplicate only of an earlier entry that was accepted: unusable and small ones leave no digest
    behind, so their repeats count as bad or small again. The first accepted entry in ``order`` is kept.
    """
    flaw = F.when(~F.coalesce(usable, F.lit(False)), "bad").when(F.coalesce(side, F.lit(0)) < min_side, "small")
    key, at, why, least = free_names(entries.columns, "entry_digest", "entry_order", "entry_flaw", "first_order")
    marked = entries.withColumn(key, digest).withColumn(at, order).withColumn(why, flaw)
    first = marked.where(F.col(why).isNull()).groupBy(key).agg(F.min(at).alias(least))
    status = F.coalesce(why, F.when(F.col(at) == F.col(least), "kept").otherwise("dup"))
    return marked.join(first, key, "left").select(*(F.col(f"`{c}`") for c in entries.columns), status.alias("status"))


def counters(classified: DataFrame) -> DataFrame:
    """One row with the number of entries of each status."""
    return classified.agg(*(F.count_if(F.col("status") == s).cast("bigint").alias(f"n_{s}") for s in STATUS))


def distinct_first(rows: DataFrame, digest: Column, order: str) -> DataFrame:
    """The first row of each digest, in the order given: one aggregation, whose partial step meets copies early."""
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    return rows.groupBy(digest.alias("__digest")).agg(F.min_by(row, order).alias("__row")).select("__row.*")


def require_rows(rows: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """``rows``, or an error when they are fewer than a catalog can be built from."""
    n = rows.limit(least).count()
    if n < least:
        raise ValueError(f"only {n} usable entries; at least {least} are needed")
    return rows


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")


def parent_name(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]+)$", 1))


def source_stem(path: Column) -> Column:
    """File name up to the export marker of augmented copies, or the whole name."""
    return F.substring_index(base_name(path), ".rf.", 1)


def source_key(source: Column, path: Column) -> Column:
    """Key that copies of one photo share: source and stem where the path holds the marker, else the path itself."""
    return F.when(F.instr(path, ".rf.") > 0, F.concat_ws("/", source, source_stem(path))).otherwise(path)


def source_name(root: Column) -> Column:
    """Last part of a root, or the data set's name in ``<name>/versions/<number>``."""
    parts = F.split(F.regexp_replace(root, "/+$", ""), "/")
    return F.when(root.rlike("/versions/[0-9]+/?$"), F.try_element_at(parts, F.lit(-3))).otherwise(F.element_at(parts, -1))


def folder_label(path: Column, root: str) -> Column:
    """Label of a gallery file: its folder, or its stem if it lies directly in the root."""
    direct = F.regexp_replace(path, "/[^/]*$", "") == root.rstrip("/")
    return F.when(direct, stem(path)).otherwise(parent_name(path))


def with_position(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` plus ``pos``, their place in the order given: one total order, needed where row order has meaning.

    Range partitions are numbered by their sizes, so no task sees all rows.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id())
    spread = cut(spread)
    sizes = spread.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__k").alias("__low"))
    starts = sizes.select("__part", "__low", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return spread.join(F.broadcast(starts), "__part").select(*rows.columns, (F.col("__start") + F.col("__k") - F.col("__low")).alias("pos"))
