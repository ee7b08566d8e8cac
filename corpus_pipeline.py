"""The corpus pipeline: five stages, each over all that its predecessor kept, written as Parquet and read again.

Defined cases, in every stage but the last the same columns come out that went in: a null, empty or word-less text
fails the quality rules; a document without an id passes them like any other, is no near-duplicate of another, keeps
its personal data replaced and is packed; rows that repeat an id and a text are near-duplicates, of which one stays,
rows that repeat an id with different texts are different documents; very long texts are worked on whole; columns of
other names pass through; an empty table gives an empty result, and without labels no document is rejected by the
classifier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latticeq.llm import packing, pii, quality_model, quality_rules, simhash
from latticeq.llm.common import remove, shared_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, and documents that fail the base rules or lose too much text."""
    return quality_rules.keep_clean(docs)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go.

    The model is fitted on the labelled documents as they came, since the rules before it have removed bad ones.
    """
    model = quality_model.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.keep_good(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences."""
    return packing.packed_digest(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", clean_lines),
    ("quality_classifier", classify),
    ("simhash_near_dedup", deduplicate),
    ("pii", redact),
    ("best_fit_packing", pack),
]

#: Hashes, compression and tokenizers have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder before the next one reads it.

    A table goes when the next one is written. The last stage reads its input while it is made (its pieces are cut
    in the checkpoint folder), so the table before it goes as well.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        made, path = stage(spark, docs, sf_dir), None
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage-{k}-{name}")
            made.write.parquet(path)
            docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return made
