"""Shared helpers: the checkpoint folder, lineage cuts and Arrow batch plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..checkpoints import checkpoint_root, cut, release

__all__ = ["arrow_rows", "checkpoint_root", "column_index", "cut", "free_name", "free_names", "in_slices", "map_rows", "numbered", "release", "remove", "shared_path"]

SLICE_ROWS = 128


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the checkpoint folder, visible to the driver and every executor."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores put before it until no column in ``taken`` has that name (ignoring case)."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """A free name for each of ``wanted``, all different."""
    found: list[str] = []
    for name in wanted:
        found.append(free_name([*taken, *found], name))
    return found


def column_index(names: list[str], wanted: str) -> int:
    """Position of ``wanted`` as Spark resolves it: exact first, then ignoring case."""
    if wanted in names:
        return names.index(wanted)
    return [n.lower() for n in names].index(wanted.lower())


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with its columns named ``c0, c1, ...``: Arrow functions take no names with dots in them."""
    return rows.toDF(*(f"c{k}" for k in range(len(rows.columns))))


def map_rows(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``run`` over the Arrow batches of ``rows``, which keep their columns and types; names may be any."""
    plain = numbered(rows)
    return plain.mapInArrow(run, plain.schema).toDF(*rows.columns)


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of few rows, so that long texts do not pile up as Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def arrow_rows(make: Callable[[], Callable[..., list]], schema: pa.Schema) -> Callable:
    """A ``mapInArrow`` function: ``make()`` is called once a task and returns ``f(*columns) -> list of columns``.

    The columns come as Python lists and go back in the order of ``schema``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for piece in in_slices(batches):
            columns = work(*(c.to_pylist() for c in piece.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run
