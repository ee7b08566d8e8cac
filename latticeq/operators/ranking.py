"""Retrieval over embedding vectors: scores, top-k, per-label maximum and identification metrics.

The side that is small enough is broadcast (both sides' bytes are checked, the gallery's first); if neither is, both
are dealt into blocks that meet pairwise, each pair of blocks in a task's share of its own. Exact either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot

KS = (1, 5, 10)
#: What a broadcast side may hold, and about how much a block, by 8 bytes an entry and ``ROW_BYTES`` a row.
BROADCAST_BYTES = 64 << 20
BLOCK_BYTES = 16 << 20
ROW_BYTES = 64


def side_bytes(rows: DataFrame, vec: str) -> int:
    """Size of one side of a search, from its rows and longest vector."""
    n, longest = rows.agg(F.count("*"), F.max(F.size(vec))).first()
    return n * (8 * max(longest or 0, 0) + ROW_BYTES)


def scores(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """``q, q_label, g, g_label, s`` for a stated query set against the gallery.

    ``queries`` has ``q, q_label, q_vec`` (and more, which is carried), ``gallery`` has ``g, g_label, g_vec``.
    """
    carried = [c for c in queries.columns if c != "q_vec"]
    wide, narrow = side_bytes(gallery, "g_vec"), None
    if wide <= BROADCAST_BYTES:
        met = queries.crossJoin(F.broadcast(gallery))
    elif (narrow := side_bytes(queries, "q_vec")) <= BROADCAST_BYTES:
        met = gallery.crossJoin(F.broadcast(queries))
    else:
        qs, gs = -(-narrow // BLOCK_BYTES), -(-wide // BLOCK_BYTES)

        def dealt(rows: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
            return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

        met = dealt(queries, "q", "__qb", qs, "__gb", gs).join(dealt(gallery, "g", "__gb", gs, "__qb", qs), ["__qb", "__gb"])
    return met.select(*carried, "g", "g_label", dot("q_vec", "g_vec").alias("s"))


def ranked(queries: DataFrame, gallery: DataFrame, by: tuple[str, ...] = ("q", "q_label"), apart: bool = False) -> DataFrame:
    """The rows of :func:`per_query`; ``apart``: a row is no result for itself.

    A gallery of a checked size is sent out as one sorted list, so each query is ranked in its own row and nothing is
    exchanged; a larger one goes through :func:`scores` and a window.
    """
    if side_bytes(gallery, "g_vec") > BROADCAST_BYTES:
        met = scores(queries, gallery)
        return per_query(met.where("q <> g") if apart else met, by)
    rows = gallery.agg(F.sort_array(F.collect_list(F.struct("g", "g_label", "g_vec"))).alias("__rows"))
    met = queries.crossJoin(F.broadcast(rows))  # one row
    others = F.filter("__rows", lambda x: x["g"] != F.col("q")) if apart else F.col("__rows")
    order = F.array_sort(F.transform(others, lambda x: F.struct((-dot(F.col("q_vec"), x["g_vec"])).alias("s"), x["g"].alias("g"), x["g_label"].alias("g_label"))))
    met = met.select(*by, F.col("q_label").alias("__label"), order.alias("__order"))
    hits = F.filter(F.transform("__order", lambda x, i: F.when(x["g_label"] == F.col("__label"), i + 1)), lambda i: i.isNotNull())
    met = met.withColumn("__hits", hits)
    precision = F.aggregate(F.transform("__hits", lambda r, i: (i + 1) / r), F.lit(0.0), lambda s, x: s + x)
    return met.select(
        *by,
        F.get("__hits", F.lit(0)).alias("first_hit"),
        (precision / F.greatest(F.size("__hits"), F.lit(1))).alias("ap"),
        F.size("__hits").cast("bigint").alias("n_hits"),
        F.get("__order", F.lit(0))["g_label"].alias("top_label"),
        F.size("__order").cast("bigint").alias("n_gallery"),
    )


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("q",)) -> DataFrame:
    """The ``k`` best gallery rows of a query with their rank; ties go to the earlier gallery row."""
    order = Window.partitionBy(*by).orderBy(F.col("s").desc(), F.col("g"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_per_label(scored: DataFrame, by: tuple[str, ...] = ("q",)) -> DataFrame:
    """A label's score is the greatest of its rows, that of the first such row; ``first_g`` is the label's first row."""
    return scored.groupBy(*by, "g_label").agg(F.max("s").alias("s"), F.max_by("g", F.struct(F.col("s"), -F.col("g"))).alias("g"), F.min("g").alias("first_g"))


def identify(scored: DataFrame, k: int = 5, by: tuple[str, ...] = ("q",)) -> DataFrame:
    """The ``k`` best labels of each query; equal scores go to the label that comes first in the gallery."""
    order = Window.partitionBy(*by).orderBy(F.col("s").desc(), F.col("first_g"))
    return best_per_label(scored, by).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def per_query(scored: DataFrame, by: tuple[str, ...] = ("q", "q_label")) -> DataFrame:
    """One row a query: rank of the first hit, average precision, number of hits, label on top.

    Ranks are counted only for hits; queries without a hit have precision 0 and count.
    """
    order = Window.partitionBy("q").orderBy(F.col("s").desc(), F.col("g"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("hit", (F.col("g_label") == F.col("q_label")).cast("int"))
    ranked = ranked.withColumn("hits", F.sum("hit").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.groupBy(*by).agg(
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_hit"),
        (F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)) / F.greatest(F.sum("hit"), F.lit(1))).alias("ap"),
        F.sum("hit").alias("n_hits"),
        F.min_by("g_label", "rank").alias("top_label"),
        F.count("*").alias("n_gallery"),
    )


def recall(k: int) -> Column:
    """Share of queries with a hit among the first ``k``; null if the gallery has fewer rows than that."""
    return F.when(F.max("n_gallery") >= k, F.avg((F.coalesce(F.col("first_hit"), F.lit(1 << 30)) <= k).cast("double")))


def identification(queries: DataFrame, by: tuple[str, ...] = (), ks: tuple[int, ...] = KS, donor: str | None = None) -> DataFrame:
    """Metrics over the rows of :func:`per_query`: recall at k, mean average precision, trap rate, count."""
    metrics = [recall(k).alias(f"r{k}") for k in ks] + [F.avg("ap").alias("map")]
    if donor:
        metrics.append(F.avg((F.col("top_label") == F.col(donor)).cast("double")).alias("trap1"))
    return queries.groupBy(*by).agg(*metrics, F.count("*").alias("n_queries"))


def rolled_up(queries: DataFrame, family: str, family_class: str) -> DataFrame:
    """Metrics per family, per class of families and over all, from one ranking."""
    metrics = [F.avg((F.coalesce(F.col("first_hit"), F.lit(1 << 30)) <= k).cast("double")).alias(f"r{k}") for k in KS]
    sets = [[F.col(family)], [F.col(family_class)], []]
    return queries.groupingSets(sets, family, family_class).agg(*metrics, F.avg("ap").alias("map"), F.count("*").alias("n_queries"))


def pair_scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` (with ``a`` and ``b``) plus ``s``: two equi-joins, then the inner product."""
    left = vectors.select(F.col("id").alias("a"), F.col("vec").alias("__va"))
    right = vectors.select(F.col("id").alias("b"), F.col("vec").alias("__vb"))
    return pairs.join(left, "a").join(right, "b").withColumn("s", dot("__va", "__vb")).drop("__va", "__vb")
