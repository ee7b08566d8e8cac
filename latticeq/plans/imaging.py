"""Queries that run numpy on images in Arrow batches; SQL has no equivalent, tests compare them with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpoint_root
from ..functions import images, vectors
from ..operators import specs, training
from ..sources import files
from .catalog import table
from .retrieval import designs

SIDE = 32
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def picture(vector: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A small picture of a vector: 21 colors as vertical bands, shaded downwards."""
    v = np.clip((np.asarray(vector, float) + 1) * 127.5, 0, 255)[:63].reshape(21, 3)
    band = v[np.arange(side) * 21 // side]
    return np.clip(band[None] * np.linspace(0.6, 1.2, side)[:, None, None], 0, 255).astype(np.uint8)


BATCH = 64


def _mapped(rows: DataFrame, f, schema: str) -> DataFrame:
    """``f`` on up to ``BATCH`` rows at a time, as columns in and out."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BATCH):
                yield pd.DataFrame(dict(zip(names, f(b.iloc[at : at + BATCH]))), columns=names)

    return rows.mapInPandas(run, schema)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), "embedding")


def _pictures(b: pd.DataFrame, column: str = "embedding") -> np.ndarray:
    return np.stack([picture(v) for v in b[column]])


def _lists(x: np.ndarray) -> list:
    return x.reshape(len(x), -1).tolist()


@query
def image_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six k-means colors of each picture and how many are left after close ones are merged."""

    def some(b):
        found = images.extract_palettes(list(_pictures(b)), b["id"])
        left = images.merged(images.Palettes(found, np.ones(found.shape[:2], bool)))
        return b["id"], _lists(found.round(3)), left.sizes

    return _mapped(_vectors(spark, sf_dir), some, "id bigint, palette array<double>, n_merged bigint")


@query
def image_phash_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-frequency block of each picture, hashed in its eight orientations."""
    from ..functions.hashing import hashes

    blocks = _mapped(_vectors(spark, sf_dir), lambda b: (b["id"], [images.low_block(x) for x in _pictures(b)]), "id bigint, block array<double>")
    return blocks.select("id", hashes("block").alias("hash"))


@query
def image_recolor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every color family on every picture: mean channels after the change, seeded by row and family."""

    def some(b):
        out = images.recolor(_pictures(b), b["family"].to_numpy(), images.Draws(b["id"] * 16 + b["ord"]))
        return b["id"], b["family"], *out.mean((1, 2)).round(4).T

    rows = _vectors(spark, sf_dir).crossJoin(F.broadcast(specs.families(spark)))  # eight families
    return _mapped(rows, some, "id bigint, family string, r double, g double, b double")


@query
def image_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random crop and a further photo of each picture."""

    def some(b):
        draws = images.Draws(b["id"])
        out = images.photo(images.random_crops(list(_pictures(b)), 24, draws), draws.fork(0))
        return b["id"], [out.shape[1]] * len(b), [out.shape[2]] * len(b), out.mean((1, 2, 3))

    return _mapped(_vectors(spark, sf_dir), some, "id bigint, height bigint, width bigint, mean double")


@query
def render_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures of a benchmark's specifications: own and donor picture are joined, the rendering is seeded by row."""
    emb = table(spark, sf_dir, "embeddings")
    own = emb.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).withColumn("label", F.col("label").cast("bigint"))
    rows = specs.build(designs(spark, sf_dir)).join(own, "label").join(own.select(F.col("label").alias("donor_label"), F.col("embedding").alias("donor")), "donor_label", "left")

    def some(b):
        donors = [None if v is None else picture(v) for v in b["donor"]]
        out = images.render(files.plain(b).to_dict("records"), list(_pictures(b)), donors, SIDE)
        return b["spec_id"], b["role"], [SIDE] * len(b), [SIDE] * len(b), out.mean((1, 2, 3))

    return _mapped(rows, some, "spec_id bigint, role string, height bigint, width bigint, mean double")


@query
def half_precision_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gallery index written and read back: vectors rounded to half precision, with their error."""
    rows = _vectors(spark, sf_dir)
    index = rows.select(F.col("id").alias("pos"), F.concat(F.lit("/g/"), F.col("id").cast("string")).alias("path"), F.lit("x").alias("label"), "embedding")
    to = f"{checkpoint_root(spark).rstrip('/')}/index-{np.random.default_rng().integers(1 << 62)}"
    files.write_index(index, to)
    read = files.read_index(spark, to).select("pos", F.col("embedding").alias("half"))
    gap = F.aggregate(F.zip_with("embedding", "half", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: F.greatest(s, x.cast("double")))
    return rows.join(read, rows["id"] == read["pos"]).select("pos", gap.alias("error"), vectors.dot("half", "half").alias("norm2"))


def _palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(_vectors(spark, sf_dir), lambda b: (b["id"], _lists(images.extract_palettes(list(_pictures(b)), b["id"]))), "pos bigint, palette array<double>")


@query
def palette_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of one epoch: half from the pictures' own palettes, half at random."""
    return training.palette_bank(_palettes(spark, sf_dir), 3)


def _views(spark: SparkSession, sf_dir: str, bank_size: int) -> DataFrame:
    epoch = 3
    key = [F.col("id"), F.col("view")]
    rows = training.views(_vectors(spark, sf_dir), 4)
    rows = training.with_targets(rows, _palettes(spark, sf_dir), epoch, key, bank_size)
    rows = rows.withColumn("family", training.weighted_choice(training.portable_uniform(str(epoch), "family", *key), list(specs.FAMILY_WEIGHTS))).withColumn("seed", training.portable_draw(str(epoch), "view", *key))

    def some(b):
        draws = images.Draws(b["seed"])
        x = images.random_crops(list(_pictures(b)), 24, draws)
        x = images.recolor(x, b["family"].to_numpy(), draws.fork(0), np.stack([np.reshape(p, (-1, 3)) for p in b["palette"]]))
        t = images.to_tensor(images.photo(x, draws.fork(1)))
        return b["id"], b["view"], b["family"], [t.shape[2]] * len(b), t.mean((1, 2, 3)).astype(float)

    return _mapped(rows, some, "id bigint, view int, family string, side bigint, mean double")


@query
def train_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four training views of each picture: a family by its weight, a target from the bank, a crop, a further photo.

    Views are seeded by epoch, picture and number, so that a rerun gives the same.
    """
    return _views(spark, sf_dir, 24)


@query
def train_views_without_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a target of its own for each view: another picture's palette or a random one."""
    return _views(spark, sf_dir, 0)
