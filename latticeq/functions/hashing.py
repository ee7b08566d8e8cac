"""Perceptual hashes from an 8 by 8 block of low-frequency coefficients, and Hamming neighbours.

Mirroring and turning an image changes its cosine coefficients by signs and a transposition only, so all eight
orientations come from one block.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 8
ORIENTATIONS = 8


def orientation_index(k: int) -> list[tuple[int, int]]:
    """For orientation ``k`` (mirror first, then quarter turns): source position and sign of each of the 64 entries."""
    flip, turns = divmod(k, 4)
    cells = [[(r, c, -1 if flip and c % 2 else 1) for c in range(SIDE)] for r in range(SIDE)]
    for _ in range(turns):
        # a quarter turn to the left transposes the block and changes the sign of the odd rows
        cells = [[(*cells[c][r][:2], cells[c][r][2] * (-1 if r % 2 else 1)) for c in range(SIDE)] for r in range(SIDE)]
    return [(r * SIDE + c, s) for row in cells for r, c, s in row]


def oriented(block: Column | str, k: int) -> Column:
    block = F.col(block) if isinstance(block, str) else block
    return F.array(*(block[i].cast("double") * s for i, s in orientation_index(k)))


def median_of_rest(block: Column) -> Column:
    """Median of the 63 entries behind the first, an element since their number is odd."""
    return F.element_at(F.array_sort(F.slice(block, 2, 63)), 32)


def bits(block: Column) -> Column:
    """64 bits, the first entry's at the top: 1 where an entry is above the median of the others."""
    # the struct is made once a block, so the median is not taken again for every entry
    held = F.array(F.struct(median_of_rest(block).alias("top"), block.alias("block")))

    def word(h: Column) -> Column:
        marks = F.transform(h["block"], lambda x: F.when(x > h["top"], F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
        return F.aggregate(marks, F.lit(0).cast("bigint"), lambda p, x: F.shiftleft(p, 1).bitwiseOR(x))

    return F.transform(held, word)[0]


def hashes(block: Column | str) -> Column:
    """The hashes of all orientations, the image as it is first."""
    return F.array(*(bits(oriented(block, k)) for k in range(ORIENTATIONS)))


def high_half(h: Column) -> Column:
    return F.shiftrightunsigned(h, 32)


def low_half(h: Column) -> Column:
    return h.bitwiseAND(F.lit(0xFFFFFFFF))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_keys(h: Column, most: int, spare: int = 1) -> Column:
    """Keys of which hashes within ``most`` bits share one at least.

    The 64 bits are cut into ``most + spare`` bands, of which ``spare`` are untouched; a key is the hash under the
    mask of so many bands. More spare bands make longer keys and shorter lists, at more keys a hash.
    """
    n = most + spare
    edges = [64 * k // n for k in range(n + 1)]
    parts = []
    for number, chosen in enumerate(combinations(range(n), spare)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        parts.append(F.struct(F.lit(number).alias("band"), h.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("part")))
    return F.array(*parts)


def spare_for(rows: int, most: int) -> int:
    """Spare bands that make keys long enough for so many rows, so that a list holds a few unrelated ones at most."""
    need = max(1, rows * ORIENTATIONS).bit_length()
    return next((k for k in range(1, 5) if 64 * k // (most + k) >= need), 4)


def _met(earlier: DataFrame, later: DataFrame, most: int, spare: int) -> DataFrame:
    """``a, b, distance``: rows of ``earlier`` (``a, ha``) and ``later`` (``b, hb``) that are near, by shared bands."""
    left = earlier.select("a", "ha", F.explode(band_keys(F.col("ha"), most, spare)).alias("k")).select("a", "ha", "k.*")
    right = later.select("b", "hb", F.explode(band_keys(F.col("hb"), most, spare)).alias("k")).select("b", "hb", "k.*")
    near = left.join(right, ["band", "part"]).where((F.col("a") < F.col("b")) & (hamming(F.col("ha"), F.col("hb")) <= most))
    return near.groupBy("a", "b").agg(F.min(hamming(F.col("ha"), F.col("hb"))).alias("distance"))


def near_pairs(rows: DataFrame, most: int, pos: str = "pos", hash_array: str = "hash", spare: int | None = None) -> DataFrame:
    """``a, b`` (a < b) where the later row's own hash is within ``most`` bits of an orientation of the earlier one.

    The rule is not symmetric: only the earlier row is turned. Rows meet on bands, which loses no pair; rows with
    one and the same hash array meet once, through their first row, and are linked to it. Keys grow with the rows.
    """
    keyed = rows.select(F.col(pos).alias("pos"), F.col(hash_array).alias("h"))
    first = keyed.groupBy("h").agg(F.min("pos").alias("first"))
    same = keyed.join(first, "h").where("first < pos").select(F.col("first").alias("a"), F.col("pos").alias("b"))
    lone = first.select(F.col("first").alias("pos"), "h")
    spare = spare or spare_for(lone.count(), most)
    close = _met(lone.select(F.col("pos").alias("a"), F.explode(F.array_distinct("h")).alias("ha")), lone.select(F.col("pos").alias("b"), F.col("h")[0].alias("hb")), most, spare)
    return close.select("a", "b").unionByName(same)


def near_pairs_full(rows: DataFrame, most: int, pos: str = "pos", hash_array: str = "hash", spare: int | None = None) -> DataFrame:
    """``a, b, distance``: all pairs by the same rule, copies included."""
    keyed = rows.select(F.col(pos).alias("pos"), F.col(hash_array).alias("h"))
    spare = spare or spare_for(keyed.count(), most)
    return _met(keyed.select(F.col("pos").alias("a"), F.explode(F.array_distinct("h")).alias("ha")), keyed.select(F.col("pos").alias("b"), F.col("h")[0].alias("hb")), most, spare)
