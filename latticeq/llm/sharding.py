"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows lie in blocks (a hash of the row; up to ``MOST_BLOCKS``, by the row count). A uniformly random arrangement of
all rows over the shards gives every block and shard a number of common rows whose joint law is the multivariate
hypergeometric one; that matrix is drawn exactly, block after block, from the true block counts. Each block then
permutes its rows and deals them out by its row of the matrix, and each shard permutes what it received. The
shards' sizes are set beforehand and differ by at most one.

DataFrame functions only; the driver handles the matrix, of at most ``MOST_BLOCKS`` times the number of shards.
A permutation is the order of random keys. It is made in ranges of the key, each of about ``BLOCK_ROWS`` rows, whose
starts are added: their number follows the rows, so no task's share does, in blocks and in shards alike.

Defined cases: null texts have no bytes; repeated rows are dealt like any others; keys are hashes of the seed and
the row, so a rerun of a lost task deals its rows alike; columns of any name pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free_names

MOST_BLOCKS = 4096
BLOCK_ROWS = 4096


def hypergeometric(colors: list[int], draws: int, rng: np.random.Generator) -> list[int]:
    """One exact multivariate hypergeometric draw, by splitting the colors in halves."""
    if len(colors) == 1:
        return [draws]
    half = len(colors) // 2
    left, right = sum(colors[:half]), sum(colors[half:])
    k = draw_one(left, right, draws, rng)
    return hypergeometric(colors[:half], k, rng) + hypergeometric(colors[half:], draws - k, rng)


def draw_one(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """One hypergeometric draw: numpy's up to its limit of 1e9 items, beyond it by inversion around the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    n = good + bad
    mode = min(max((draws + 1) * (good + 1) // (n + 2), low), high)
    wide = int(14 * np.sqrt(draws * (good / n) * (bad / n) * ((n - draws) / max(n - 1, 1)))) + 40  # what is outside weighs under 1e-40
    k = np.arange(max(low, mode - wide), min(high, mode + wide) + 1, dtype=np.float64)
    step = np.log((good - k[:-1]) * (draws - k[:-1])) - np.log((k[:-1] + 1) * (bad - draws + k[:-1] + 1))
    weight = np.concatenate(([0.0], np.cumsum(step)))
    total = np.cumsum(np.exp(weight - weight.max()))
    return int(k[min(np.searchsorted(total, rng.random() * total[-1], side="right"), len(k) - 1)])


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of each block that each shard receives; row sums are ``counts``, column sums ``sizes``."""
    rng, left, out = np.random.default_rng(seed), list(sizes), []
    for n in counts:
        out.append(hypergeometric(left, n, rng))
        left = [a - b for a, b in zip(left, out[-1])]
    return out


def _key(seed: int, salt: int, cols: list[Column]) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), *cols)


def _bits(rows: int) -> int:
    """Of a key's leading bits so many that a range of them holds about ``BLOCK_ROWS`` of the rows."""
    return max(0, (rows // BLOCK_ROWS).bit_length())


def _ranked(rows: DataFrame, group: str, key: str, bits: int, ties: list[Column], rank: str) -> DataFrame:
    """``rows`` plus ``rank``, their place (from 1) in their group by the key, counted range by range."""
    part, start, n = free_names(rows.columns, "key_range", "range_start", "range_rows")
    spread = rows.withColumn(part, F.shiftrightunsigned(F.col(key), 64 - bits) if bits else F.lit(0).cast("bigint"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy(group, part).agg(F.count("*").alias(n)).select(group, part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    inside = F.row_number().over(Window.partitionBy(group, part).orderBy(key, *ties))
    return spread.withColumn(rank, inside).join(starts, [group, part]).withColumn(rank, F.col(rank) + F.col(start)).drop(part, start)


def shuffle_into_shards(rows: DataFrame, shards: int = 24, seed: int = 42, identity: list[str] | None = None, blocks: int | None = None) -> DataFrame:
    """``rows`` plus ``shard`` and ``slot`` (gapless from 0 in each shard). ``identity``: the columns that tell rows apart.

    If ``rows`` has columns of these names already, the new ones get an underscore before theirs.
    """
    spark = rows.sparkSession
    shard, slot, block, key, rank, own, bounds = free_names(rows.columns, "shard", "slot", "block", "shuffle_key", "shuffle_rank", "own_block", "bounds")
    given = [F.col(f"`{c}`") for c in rows.columns]
    cols = [F.col(f"`{c}`") for c in identity or rows.columns]
    rows = cut(rows)
    n = rows.count()
    blocks = blocks or max(1, min(MOST_BLOCKS, -(-n // BLOCK_ROWS)))
    placed = rows.withColumn(block, F.pmod(_key(seed, 1, cols), F.lit(blocks)).cast("int")).withColumn(key, _key(seed, 2, cols))
    counts = {r[0]: r[1] for r in placed.groupBy(block).agg(F.count("*")).collect()}
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], sizes, seed)
    table = spark.createDataFrame([(b, np.cumsum(r).tolist()) for b, r in enumerate(matrix)], f"{own} int, {bounds} array<bigint>")
    local = _ranked(placed, block, key, _bits(max(counts.values(), default=0)), cols, rank)
    dealt = local.join(F.broadcast(table), F.col(block) == F.col(own)).withColumn(shard, F.size(F.filter(bounds, lambda x: x < F.col(rank))))
    dealt = cut(dealt.select(*given, shard, _key(seed, 3, cols).alias(key)))
    return _ranked(dealt, shard, key, _bits(n // shards), cols, slot).select(*given, shard, (F.col(slot) - 1).alias(slot))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 4 over all documents: 24 shards under the law of equal row counts."""
    return sharded_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sharded_digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = shuffle_into_shards(rows, shards)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
