"""Index, identify and verify: the catalog's interface for use outside of reports.

Vectors come from an *embedder*: any function from a list of RGB arrays to a list of vectors. It runs in Arrow
batches on the executors; no model is part of this library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images, vectors
from ..sources import files
from . import ingest, ranking

Embedder = Callable[[list[np.ndarray]], list[list[float]]]
DEFAULT_TAU = 0.5
BATCH = 64


def embedded(embedder: Embedder, shown: list[np.ndarray], views: bool) -> np.ndarray:
    """Normalised vectors of a batch; ``views`` merges each image's with its mirror's."""

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    out = unit(np.array(embedder(shown), float))
    return unit(out + unit(np.array(embedder([x[:, ::-1] for x in shown]), float))) if views else out


class CatalogMatcher:
    """Identification and verification with one embedder; ``views`` merges each image with its mirror."""

    def __init__(self, spark: SparkSession, embedder: Embedder, tau: float | None = None, views: bool = True, size: int = 224):
        self.spark, self.embedder, self.views, self.size = spark, embedder, views, size
        self.tau = DEFAULT_TAU if tau is None else tau

    def embed(self, *roots: str) -> DataFrame:
        """``path, embedding`` of the images below the roots; a file that cannot be decoded is an error."""
        embedder, views, size = self.embedder, self.views, self.size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), BATCH):
                    rows = files.plain(batch.iloc[at : at + BATCH]).to_dict("records")
                    broken = [r["path"] for r in rows if r["height"] <= 0]
                    if broken:
                        raise ValueError(f"cannot decode {broken[0]}")
                    shown = [images.center_crop(files.pixels(r), size) for r in rows]
                    yield pd.DataFrame({"path": [r["path"] for r in rows], "embedding": embedded(embedder, shown, views).tolist()})

        return files.decode(self.spark, *roots).mapInPandas(run, "path string, embedding array<float>")

    def build_index(self, root: str, path: str) -> DataFrame:
        """Embed a folder and store the index; a file's label is its folder, or its stem directly in the root."""
        full = F.regexp_replace(F.col("path"), "^file:/*", "/")
        rows = self.embed(root).withColumn("label", ingest.folder_label(full, root))
        files.write_index(ingest.with_position(rows, "path"), path)
        return files.read_index(self.spark, path)

    def identify(self, image: str, index: DataFrame, k: int = 5) -> DataFrame:
        """``rank, label, score, path``: the best labels of one image; the query's vector is a literal of the plan."""
        query = self.embed(image).first()["embedding"]
        scored = index.select(F.lit(0).alias("q"), F.col("pos").alias("g"), F.col("label").alias("g_label"), vectors.dot(F.array(*(F.lit(x) for x in query)), "embedding").alias("s"))
        best = ranking.best_per_label(scored).orderBy(F.desc("s"), "first_g").limit(k)
        return best.join(index.select(F.col("pos").alias("g"), "path"), "g").select(F.row_number().over(ranking.Window.orderBy(F.desc("s"), "first_g")).alias("rank"), F.col("g_label").alias("label"), F.col("s").alias("score"), "path").orderBy("rank")

    def verify(self, a: str, b: str) -> tuple[bool, float]:
        """Whether two images show one design, and the score."""
        va, vb = (np.array(self.embed(x).first()["embedding"], float) for x in (a, b))
        score = float(va @ vb)
        return score >= self.tau, score


def thumbnail_embedder(side: int = 8) -> Embedder:
    """A stand-in without a model: the centered gray thumbnail."""

    def embed(batch: list[np.ndarray]) -> list[list[float]]:
        out = [images.resize(images.luma(x), side, side).ravel() for x in batch]
        return [(v - v.mean() + 1e-6).tolist() for v in out]

    return embed
