"""Tables around training: supervised contrastive loss, batches, views, schedules, model selection, reports."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import images
from ..functions.vectors import dot
from .ingest import with_position

TEMPERATURE = 0.07
#: Random palettes of different epochs have different seeds up to this bank size.
BANK_STREAMS = 1 << 20


def contrastive_loss(batch: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """``loss`` of one or more batches (``batch_id, id, label, vec``, vectors normalised).

    For each anchor: the mean log-probability of its positives under a softmax over all others of its batch, shifted
    by the greatest logit. Anchors without positives are left out of the mean. Pairs exist within batches only.
    """
    other = batch.select("batch_id", F.col("id").alias("id2"), F.col("label").alias("label2"), F.col("vec").alias("vec2"))
    logits = batch.join(other, "batch_id").where("id <> id2").select("batch_id", "id", (F.col("label") == F.col("label2")).alias("positive"), (dot("vec", "vec2") / temperature).alias("x"))
    top = logits.groupBy("batch_id", "id").agg(F.max("x").alias("m"))
    anchors = logits.join(top, ["batch_id", "id"]).groupBy("batch_id", "id").agg(
        (F.max("m") + F.log(F.sum(F.exp(F.col("x") - F.col("m"))))).alias("lse"), F.sum(F.when(F.col("positive"), F.col("x"))).alias("sum_pos"), F.count_if("positive").alias("n_pos")
    )
    return anchors.where("n_pos > 0").groupBy("batch_id").agg(F.avg(F.col("lse") - F.col("sum_pos") / F.col("n_pos")).alias("loss"), F.count("*").alias("n_anchors"))


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """``rows`` (with a dense 0-based ``order``) plus ``batch_id`` and ``slot``; the last, partial batch is dropped."""
    n = rows.count() // size * size
    at = F.col(order)
    return rows.where(at < n).withColumn("batch_id", F.floor(at / size).cast("bigint")).withColumn("slot", (at % size).cast("bigint"))


def shuffled_batches(rows: DataFrame, key: str, size: int, epoch: int) -> DataFrame:
    """``rows`` in an epoch's own order (a digest of epoch and key), then as :func:`batches`."""
    drawn = rows.withColumn("__draw", F.md5(F.concat(F.lit(f"{epoch}-"), F.col(key).cast("string"))))
    return batches(with_position(drawn, "__draw", key).drop("__draw"), "pos", size).drop("pos")


def epoch_losses(steps: DataFrame) -> DataFrame:
    """``epoch, loss, n_steps``: the mean of each epoch's step losses."""
    return steps.groupBy("epoch").agg(F.avg("loss").alias("loss"), F.count("*").alias("n_steps"))


def views(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows for each row, numbered by ``view``; labels repeat with them."""
    return rows.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def learning_rate(step: Column, steps: int, warmup: int, base: float) -> Column:
    """Linear warm-up, then half a cosine down to zero."""
    progress = (step - warmup) / float(max(1, steps - warmup))
    return F.when(step < warmup, base * (step + 1) / float(max(1, warmup))).otherwise(base * 0.5 * (1.0 + F.cos(F.lit(math.pi) * progress)))


def best_epochs(history: DataFrame, score: str = "val_score", order: str = "epoch") -> DataFrame:
    """Epochs at which a checkpoint is written: those that beat every earlier score. One run's history is small."""
    before = F.max(score).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return history.where(F.col(score).isNotNull()).withColumn("saved", before.isNull() | (F.col(score) > before))


def weighted_choice(u: Column, weights: list[tuple[str, float]]) -> Column:
    """Name whose part of the cumulative weights holds ``u`` of [0, 1)."""
    total, run, out = sum(w for _, w in weights), 0.0, None
    for name, w in weights[:-1]:
        run += w / total
        out = F.when(u < run, name) if out is None else out.when(u < run, name)
    return out.otherwise(weights[-1][0])


def portable_draw(*parts: Column | str) -> Column:
    """An integer of [0, 2**32) from an MD5 of the parts: the same in every engine."""
    text = F.concat_ws("-", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def portable_uniform(*parts: Column | str) -> Column:
    return portable_draw(*parts) / 4294967296.0


def bank_sources(spark: SparkSession, n: int, epoch: int, size: int = 24) -> DataFrame:
    """``bank_id, pos``: for the first half of a bank, which of ``n`` palettes it takes; repeats are allowed."""
    drawn = spark.range(size // 2 if n else 0).withColumnRenamed("id", "bank_id")
    return drawn.select("bank_id", (portable_draw(str(10_000 + epoch), "bank", F.col("bank_id")) % max(n, 1)).alias("pos"))


def palette_bank(palettes: DataFrame, epoch: int, size: int = 24) -> DataFrame:
    """``bank_id, palette``: an epoch's targets, the first half drawn from real palettes with replacement, the rest made.

    ``palettes`` has a dense 0-based ``pos`` and a flat ``palette``. The bank has ``size`` rows; none if that is 0.
    """
    spark, n = palettes.sparkSession, palettes.count()
    real = size // 2 if n else 0
    own = bank_sources(spark, n, epoch, size).join(palettes.select("pos", "palette"), "pos").select("bank_id", "palette")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = _random(b["bank_id"].to_numpy() + (10_000 + epoch) * BANK_STREAMS)
            yield pd.DataFrame({"bank_id": b["bank_id"], "palette": found})

    return own.unionByName(spark.range(real, size).select(F.col("id").alias("bank_id")).mapInPandas(made, "bank_id bigint, palette array<double>"))


def _random(seeds: np.ndarray) -> list[list[float]]:
    found = images.random_palettes(np.full(len(seeds), 6), images.Draws(seeds)).colors if len(seeds) else np.zeros((0, 6, 3))
    return found.reshape(len(seeds), -1).tolist()


def with_targets(rows: DataFrame, palettes: DataFrame, epoch: int, key: list[Column], size: int = 24) -> DataFrame:
    """``rows`` plus ``palette``, the target of each row (told apart by ``key``).

    With a bank all rows share its few targets. Without one (``size`` 0) every row has its own: half the rows take
    the palette of a row of ``palettes`` (dense ``pos``), half a random one.
    """
    if size:
        bank = F.broadcast(palette_bank(palettes, epoch, size))  # as many rows as its size
        return rows.withColumn("bank_id", portable_draw(str(epoch), "target", *key) % size).join(bank, "bank_id")
    n = palettes.count()
    drawn = rows.withColumn("__own", portable_uniform(str(epoch), "real", *key) < 0.5).withColumn("__pos", portable_draw(str(epoch), "target", *key) % max(n, 1)).withColumn("__seed", portable_draw(str(epoch), "random", *key))
    real = drawn.where("__own").join(palettes.select(F.col("pos").alias("__pos"), "palette"), "__pos").select(*rows.columns, "palette")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="__seed").assign(palette=_random(b["__seed"].to_numpy()))

    rest = drawn.where("NOT __own" if n else "true").select(*rows.columns, "__seed")
    return real.unionByName(rest.mapInPandas(made, StructType([*rows.schema.fields, StructField("palette", ArrayType(DoubleType()))])))
