"""From a manifest to the benchmark's metrics: render every specification, embed it once, run all protocols."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import images
from ..sources import files
from . import benchmark, ingest, specs
from .matcher import BATCH, Embedder, embedded


def designs_of(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``label, path`` of each group's representative (its least path), and ``label, photo`` of all other photos."""
    first = items.groupBy("group").agg(F.min("path").alias("path"))
    numbers = cut(ingest.with_position(first, "group").withColumnRenamed("pos", "label"))
    rest = items.select("group", F.col("path").alias("photo")).join(numbers, "group").where("photo <> path").select("label", "photo")
    return numbers.select("label", "path"), rest


def embed_specs(spec: DataFrame, designs: DataFrame, cache: DataFrame, embedder: Embedder, size: int = 224, gray: bool = False, views: bool = False) -> DataFrame:
    """``spec_id, embedding`` of every specification; ``cache`` has decoded pictures by path.

    Own and donor picture are joined by path, as is the donor's palette, which is found once a design. A batch of rows
    is rendered and embedded together. ``gray`` hands on gray pictures, ``views`` merges each with its mirror.
    """
    known = ("height", "width", "channels", "pixels")
    paths = spec.join(designs, "label").withColumn("path", F.coalesce("photo", "path"))
    paths = paths.join(designs.select(F.col("label").alias("donor_label"), F.col("path").alias("donor_path")), "donor_label", "left")
    rows = paths.join(cache.select("path", *known), "path")
    rows = rows.join(cache.select(F.col("path").alias("donor_path"), *(F.col(c).alias(f"donor_{c}") for c in known)), "donor_path", "left")

    def colors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shown = [files.pixels(r) for r in files.plain(batch).to_dict("records")]
            found = images.extract_palettes(shown, np.zeros(len(shown), np.int64))
            yield pd.DataFrame({"donor_path": batch["path"], "palette": found.reshape(len(shown), -1).tolist()})

    own = cache.select("path", *known).join(designs.select("path"), "path", "left_semi")
    rows = rows.join(own.mapInPandas(colors, "donor_path string, palette array<double>"), "donor_path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                some = files.plain(batch.iloc[at : at + BATCH]).to_dict("records")
                donors = [None if r["donor_pixels"] is None else files.pixels({c: r[f"donor_{c}"] for c in known}) for r in some]
                shown = images.render(some, [files.pixels(r) for r in some], donors, size, [r["palette"] for r in some])
                if gray:
                    shown = np.repeat(images.luma(shown).astype(np.uint8)[..., None], 3, -1)
                yield pd.DataFrame({"spec_id": [r["spec_id"] for r in some], "embedding": embedded(embedder, list(shown), views).tolist()})

    return rows.mapInPandas(run, "spec_id bigint, embedding array<float>")


def prepared(items: DataFrame, cache: DataFrame, embedder: Embedder, seed: int = 0, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Specifications, pairs and vectors of one split's items."""
    designs, rest = designs_of(items)
    spec = cut(specs.build(designs, rest, seed))
    return spec, specs.pairs(designs, seed), cut(embed_specs(spec, designs, cache, embedder, **how))


def evaluate(spark: SparkSession, manifest: str, cache: str, embedder: Embedder, model: str, out: str | None = None, split: str = "test", seed: int = 0, **how) -> dict:
    """The threshold comes from the validation split and is applied to ``split`` unchanged.

    The result has ``model, split, val_threshold, headline, full`` and goes to ``out`` as one JSON document.
    """
    stored = files.read_cache(spark, cache)
    sides = [prepared(files.read_manifest(spark, manifest, name), stored, embedder, seed, **how) for name in ("val", split)]
    tau, metrics = benchmark.calibrated(*sides)
    metrics = cut(metrics)
    head = benchmark.headline(metrics).first().asDict()
    full: dict = {}
    for r in metrics.collect():  # some hundred numbers
        full.setdefault(r["protocol"], {}).setdefault(r["family"], {})[r["metric"]] = r["value"]
    result = {"model": model, "split": split, "val_threshold": tau, "headline": head, "full": full}
    if out:
        files.write_document(spark, result, out)
    return result
