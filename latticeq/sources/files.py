"""Sources and sinks: image trees, manifests, indexes, results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images
from ..operators import ingest

#: File suffixes that count as images.
SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")
MANIFEST = "path string, source string, orig string, group bigint, split string"


def scan_images(spark: SparkSession, *roots: str, content: bool = True) -> DataFrame:
    """``root_ord, source, path, length, content`` of the image files below the roots, suffixes in any case.

    The position in (root, path) order is added by :func:`latticeq.operators.ingest.with_position` where it is needed.
    """
    parts = []
    for k, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        files = files.where(ingest.suffix(F.col("path")).isin(*SUFFIXES))
        parts.append(files.select(F.lit(k).alias("root_ord"), ingest.source_name(F.lit(root)).alias("source"), "path", "length", *(["content"] if content else [])))
    return reduce(DataFrame.unionByName, parts)


def decode(spark: SparkSession, *roots: str) -> DataFrame:
    """``path, height, width, channels, pixels, orientation`` by the built-in image reader; undecodable files have height -1.

    ``orientation`` is null for files that stand upright; :func:`pixels` turns the others.
    """
    frames = [spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(r) for r in roots]
    i = reduce(DataFrame.unionByName, frames).select("image.*")
    rows = i.where(ingest.suffix(F.col("origin")).isin(*SUFFIXES)).select(F.regexp_replace("origin", "^([a-z]+):///", "$1:/").alias("path"), "height", "width", F.col("nChannels").alias("channels"), F.col("data").alias("pixels"))
    return rows.join(orientations(spark, *roots), "path", "left")


def exif_orientation(data: bytes) -> int:
    """The orientation (1 to 8) that a JPEG file's EXIF part names; 1 without one."""
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while data[at : at + 1] == b"\xff" and at + 4 <= len(data) and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        part = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and part[:6] == b"Exif\0\0" and part[6:8] in (b"II", b"MM"):
            part, order = part[6:], "little" if part[6:8] == b"II" else "big"
            first = int.from_bytes(part[4:8], order)
            for k in range(int.from_bytes(part[first : first + 2], order)):
                entry = part[first + 2 + 12 * k : first + 14 + 12 * k]
                if int.from_bytes(entry[:2], order) == 0x112:
                    found = int.from_bytes(entry[8:10], order)
                    return found if 1 <= found <= 8 else 1
        at += 2 + size
    return 1


def orientations(spark: SparkSession, *roots: str) -> DataFrame:
    """``path, orientation`` of the JPEG files that do not stand upright."""
    files = scan_images(spark, *roots).where(ingest.suffix(F.col("path")).isin(".jpg", ".jpeg")).select("path", F.substring("content", 1, 1 << 17).alias("head"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = pd.DataFrame({"path": b["path"], "orientation": [exif_orientation(bytes(h)) for h in b["head"]]})
            yield rows[rows["orientation"] > 1]

    return files.mapInPandas(run, "path string, orientation int")


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """An image as its EXIF orientation means it to be seen."""
    if orientation in (2, 4, 5, 7):
        image = image[:, ::-1]
    return np.ascontiguousarray(np.rot90(image, {3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(orientation, 0)))


def pixels(row: dict) -> np.ndarray:
    """Upright RGB array of a decoded row: gray is repeated, alpha is dropped, the stored order is blue first."""
    x = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"], row["channels"])
    x = np.repeat(x, 3, -1) if row["channels"] == 1 else np.ascontiguousarray(x[..., 2::-1])
    return upright(x, row.get("orientation") or 1)


def plain(b: pd.DataFrame) -> pd.DataFrame:
    """A batch with None for missing values."""
    return b.astype(object).where(b.notna(), None)


def map_images(decoded: DataFrame, f: Callable[[np.ndarray], list], schema: str, column: str = "value") -> DataFrame:
    """``path`` and ``f(image)`` for each decodable row, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for r in plain(batch).to_dict("records") if r["height"] > 0]
            yield pd.DataFrame({"path": [r["path"] for r in rows], column: [f(pixels(r)) for r in rows]})

    return decoded.mapInPandas(run, f"path string, {column} {schema}")


def prepare(spark: SparkSession, roots: list[str], min_side: int = 96, hash_most: int = 6, seed: int = 0, draw: str = "md5", cache: str | None = None) -> tuple[DataFrame, DataFrame]:
    """From image trees to a manifest (``path, source, orig, group, split``) and the ingest counters.

    ``orig`` is the file, ``path`` its place in the cache (:func:`write_cache`), or the file if there is none. Scan, drop unusable, small and repeated files, hash, link near-duplicates and copies of one photo, number the
    groups by first appearance, and split them so that no group is in two splits.
    """
    from ..functions.hashing import hashes, near_pairs
    from ..operators.groups import dense_groups, group_roots, key_edges, split_groups

    files = ingest.with_position(scan_images(spark, *roots).select("root_ord", "source", "path", F.md5("content").alias("md5")), "root_ord", "path")
    shown = decode(spark, *roots).select("path", "height", "width")
    known = files.join(shown, "path", "left")
    status = ingest.classify(known, F.col("md5"), F.least("height", "width"), F.col("height") > 0, F.col("pos"), min_side)
    kept = ingest.require_rows(status.where("status = 'kept'"))
    blocks = map_images(decode(spark, *roots).join(kept.select("path"), "path", "left_semi"), images.low_block, "array<double>", "block")
    rows = kept.join(blocks, "path").select("pos", "path", "source", "md5", hashes("block").alias("hash"))
    from ..checkpoints import cut

    rows = cut(rows.withColumn("key", ingest.source_key(F.col("source"), F.col("path"))))
    edges = near_pairs(rows, hash_most).unionByName(key_edges(rows, "key"))
    grouped = cut(dense_groups(group_roots(rows, edges)))
    split = split_groups(grouped, seed, draw=draw)
    stored = F.concat(F.lit(f"{cache.rstrip('/')}/"), "md5") if cache else F.col("path")
    manifest = rows.join(grouped, "pos").join(split, "group").select("pos", stored.alias("path"), "source", F.col("path").alias("orig"), F.col("group").cast("bigint").alias("group"), "split")
    return manifest, ingest.counters(status)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """CSV with a header, in row order."""
    manifest.repartitionByRange("pos").sortWithinPartitions("pos").select("path", "source", "orig", "group", "split").write.mode("overwrite").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    rows = spark.read.schema(MANIFEST).option("header", True).csv(path).select("path", "source", "group", "split")
    return rows if split is None else rows.where(F.col("split") == split)


def write_cache(decoded: DataFrame, short: int, path: str, manifest: DataFrame | None = None) -> None:
    """Resized upright pixels by path (a manifest's, else the file's); paths that are stored already are left out.

    The rows are like those of :func:`decode`, so whatever reads decoded files reads the cache as well.
    """
    spark = decoded.sparkSession
    if manifest is not None:
        decoded = decoded.withColumnRenamed("path", "orig").join(manifest.select("orig", "path"), "orig").drop("orig")
    try:
        decoded = decoded.join(spark.read.parquet(path).select("path"), "path", "left_anti")
    except Exception as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise

    def small(image: np.ndarray) -> dict:
        out = images.resize_short(image, short)
        return {"height": out.shape[0], "width": out.shape[1], "channels": 3, "pixels": out[..., ::-1].tobytes()}

    map_images(decoded, small, "struct<height:int,width:int,channels:int,pixels:binary>", "image").select("path", "image.*").write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_index(rows: DataFrame, path: str) -> None:
    """``pos, path, label, embedding``, rounded to half precision."""
    from ..functions.vectors import half_precision

    rows.select("pos", "path", "label", half_precision(F.col("embedding").cast("array<float>")).alias("embedding")).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_results(headline: DataFrame, path: str) -> None:
    headline.write.mode("overwrite").json(path)


def write_document(spark: SparkSession, content: dict, path: str) -> None:
    """One JSON document (a configuration, a history, a result, efficiency figures) in a folder of that name."""
    row = spark.createDataFrame([(json.dumps(content, ensure_ascii=False),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per result file, named by its stem."""
    return spark.read.option("multiLine", True).json(path).withColumn("model", ingest.stem(F.input_file_name()))


def root_prefixes(paths: DataFrame, column: str, depth: int = 4) -> DataFrame:
    """Distinct leading path parts, sorted."""
    return paths.select(F.array_join(F.slice(F.split(column, "/"), 1, depth), "/").alias("root")).distinct().orderBy("root")
