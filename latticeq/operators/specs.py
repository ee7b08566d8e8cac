"""Benchmark specifications: a seeded description of renderings, as a table.

Designs are the representatives of groups. Every design gives one gallery row, one row for each color family, one
trap, two rows for each shared-palette round, and a row for each further photo; and pairs of three kinds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .training import portable_draw

#: The color families, in order, and those that training never sees.
TRAIN_FAMILIES = ("palette_random", "palette_permute", "palette_transfer", "hsv", "channel", "gray")
HELD_OUT_FAMILIES = ("curves", "reinhard")
FAMILIES = TRAIN_FAMILIES + HELD_OUT_FAMILIES
#: How often training takes each family, identity first.
FAMILY_WEIGHTS = (("identity", 0.08), ("palette_random", 0.25), ("palette_permute", 0.12), ("palette_transfer", 0.30), ("hsv", 0.12), ("channel", 0.08), ("gray", 0.05))
SHARED_ROUNDS = 3
PAIRS_PER_DESIGN = 2
SCHEMA = "spec_id bigint, op string, role string, label bigint, family string, donor_label bigint, seed bigint, strict boolean, round int, pal_seed bigint, aug boolean, photo string"


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, f, "heldout" if f in HELD_OUT_FAMILIES else "train") for k, f in enumerate(FAMILIES)], "ord int, family string, family_class string")


def other_than(i: Column, j: Column) -> Column:
    """A draw ``j`` of [0, n - 1) as an index of [0, n) that is not ``i``."""
    return j + F.when(j >= i, 1).otherwise(0)


def donor(i: Column, n: Column | int) -> Column:
    """A fixed other design, without a draw."""
    n = F.lit(n) if isinstance(n, int) else n
    return other_than(i, (i * 7) % (n - 1))


def build(designs: DataFrame, extra_photos: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """The specification table; ``designs`` has a dense 0-based ``label``, ``extra_photos`` a ``label`` each.

    Draws are digests of seed, role and place: the same in any engine and any partitioning.
    """
    n = designs.count()
    if n < 3:
        raise ValueError("a benchmark needs three designs at least")
    fam, label, rounds, k = families(designs.sparkSession), F.col("label"), SHARED_ROUNDS, len(FAMILIES)

    def seeded(*what: Column | str) -> Column:
        return portable_draw(str(seed), *what) % (1 << 31)

    def pick(*what: Column | str) -> Column:
        return other_than(label, portable_draw(str(seed), "donor", *what) % (n - 1))

    def row(rows: DataFrame, spec_id: Column, op: str, role: str, **own: Column) -> DataFrame:
        kinds = [c.split() for c in SCHEMA.split(", ")]
        fixed = {"spec_id": spec_id, "op": F.lit(op), "role": F.lit(role), "label": label} | own
        return rows.select(*(fixed.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds))

    base = n * (k + 2)
    gallery = row(designs, label, "orig", "gallery")
    colorway = row(designs.crossJoin(F.broadcast(fam)), n + label * k + F.col("ord"), "colorway", "p1", family=F.col("family"), donor_label=pick("p1", label, F.col("ord")), seed=seeded("p1", label, F.col("ord")), strict=F.lit(False))
    trap = row(designs, n * (k + 1) + label, "colorway", "trap", family=F.lit("palette_transfer"), donor_label=pick("trap", label), seed=seeded("trap", label), strict=F.lit(True))
    each = designs.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    shared = row(each, base + (F.col("round") * 2 + F.col("side")) * n + label, "palette", "shared", seed=seeded("shared", F.col("round"), F.col("side"), label), round=F.col("round"), pal_seed=seeded("palette", F.col("round"), F.col("side")), aug=F.col("side") == 1)
    parts = [gallery, colorway, trap, shared]
    if extra_photos is not None:
        from .ingest import with_position

        parts.append(row(with_position(extra_photos, "label", "photo"), base + 2 * rounds * n + F.col("pos"), "orig", "rephoto", photo=F.col("photo")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pairs(designs: DataFrame, seed: int = 0, per_design: int = PAIRS_PER_DESIGN) -> DataFrame:
    """``kind, a, b`` (specification ids): genuine, impostors at random, and impostors in one shared palette.

    The latter are two different designs of a round's gallery side, which all wear one palette.
    """
    n, k, label = designs.count(), len(FAMILIES), F.col("label")
    each = designs.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(per_design - 1))))

    def draw(what: str, most: int) -> Column:
        return portable_draw(str(seed), what, label, F.col("t")) % most

    j, i = (other_than(label, draw(what, n - 1)) for what in ("other", "same"))
    f = draw("family", k)
    at = n * (k + 2)
    r = draw("round", SHARED_ROUNDS)
    return (
        each.select(F.lit("genuine").alias("kind"), label.alias("a"), (n + label * k + f).alias("b"))
        .unionByName(each.select(F.lit("impostor_random").alias("kind"), label.alias("a"), (n + j * k + f).alias("b")))
        .unionByName(each.select(F.lit("impostor_samepal").alias("kind"), (at + r * 2 * n + label).alias("a"), (at + r * 2 * n + i).alias("b")))
    )


def shared_stream(n: int, seed: int = 0) -> list[tuple[int, int]]:
    """Donor and seed of the family rows from one sequential numpy generator, for parity with a seeded stream."""
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        for _ in FAMILIES:
            j = int(rng.integers(n - 1))
            out.append((j + (j >= i), int(rng.integers(1 << 31))))
    return out
