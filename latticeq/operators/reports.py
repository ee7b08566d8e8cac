"""Reports: model names, tables side by side, and latency of a callable."""

from __future__ import annotations

import glob
import time
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files


def model_name(checkpoint: str | None = None, backbone: str | None = None, gray: bool = False) -> str:
    """The checkpoint's folder, or a name for a backbone that was not trained."""
    if checkpoint:
        return checkpoint.rstrip("/").split("/")[-2]
    return f"zeroshot_{backbone}" + "_gray" * gray


def side_by_side(headlines: dict[str, DataFrame]) -> DataFrame:
    """One row a model."""
    return reduce(DataFrame.unionByName, (h.select(F.lit(name).alias("model"), "*") for name, h in headlines.items()))


def markdown(table: DataFrame, digits: int = 3) -> str:
    """A small table as text; numbers with so many decimals, nulls empty."""
    rows = [table.columns, ["---"] * len(table.columns)]
    rows += [["" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v) for v in r] for r in table.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def catalog_summary(manifest: DataFrame) -> DataFrame:
    """Images, groups, and groups of more than one image."""
    sizes = manifest.groupBy("group").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n_images"), F.count("*").alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_multi"))


def source_by_split(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("source").pivot("split", ["train", "val", "test"]).count().fillna(0)


def discover_roots(*patterns: str, depth: int = 4) -> list[str]:
    """Roots of the images that patterns match, on the driver's file system: distinct leading path parts, sorted."""
    found = {p for pattern in patterns for p in glob.glob(pattern, recursive=True) if p.lower().endswith(files.SUFFIXES)}
    return sorted({"/".join(p.split("/")[: depth + 1]) for p in found})


def latency(call: Callable[[], object], n: int = 50, warm: int = 10) -> float:
    """Mean milliseconds of a call after warm-up calls."""
    for _ in range(warm):
        call()
    began = time.perf_counter()
    for _ in range(n):
        call()
    return (time.perf_counter() - began) / n * 1000


def efficiency(embedder: Callable, size: int = 224, n: int = 50, warm: int = 10) -> dict[str, float | str]:
    """Latency of an embedder for one picture and throughput for 64, size of its vectors."""
    shown = list(np.random.default_rng(0).integers(0, 256, (64, size, size, 3), dtype=np.uint8))
    dim = len(embedder(shown[:1])[0])
    batch = latency(lambda: embedder(shown), max(1, n * 2 // 5), 1)
    return {"input": f"{size}x{size}", "embedding_dim": dim, "embedding_bytes_fp16": 2 * dim, "latency_ms_bs1": latency(lambda: embedder(shown[:1]), n, warm), "throughput_img_s_bs64": 64_000 / max(batch, 1e-9)}


def samples(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows for a report, drawn by a digest of seed and key: the same in any partitioning."""
    draw = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    return rows.orderBy(draw, key).limit(n)


def parameter_bytes(n_parameters: int, dim: int, n_items: int, width: int = 2) -> dict[str, float]:
    """Size of an index of so many vectors, and of the model's parameters in 32 bits."""
    return {"params_m": n_parameters / 1e6, "embedding_bytes": dim * width, "gallery_gb": n_items * dim * width / 1e9, "params_mb": n_parameters * 4 / 1e6}
