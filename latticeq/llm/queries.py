"""Registry of the subpackage's queries, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, media, packing, pii, quality_model, quality_rules, sharding, simhash, warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_simhash": simhash.op1,
    "op2_pii": pii.op2,
    "op3_chat": chat.op3,
    "op4_sharding": sharding.op4,
    "op5_quality_model": quality_model.op5,
    "op6_warc": warc.op6,
    "op7_packing": packing.op7,
    "op8_quality_rules": quality_rules.op8,
    "op9_bpe": bpe.op9,
    "op10_media": media.op10,
}

ORACLE_SQL: dict[str, str] = {"op3_chat": chat.OP3_SQL, "op6_warc": warc.OP6_SQL, "op8_quality_rules": quality_rules.OP8_SQL}
