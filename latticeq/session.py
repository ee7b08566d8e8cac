"""A session for large tables: what the plans here count on, each setting overridable by the caller."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution splits skewed joins and merges small partitions, so the shuffle count is set high and cut down.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
PARTITION_BYTES = 128 << 20


def shuffle_partitions(input_bytes: int, cores: int) -> int:
    """Enough partitions for the input at 128 MB each, and three a core at least."""
    return max(3 * cores, -(-input_bytes // PARTITION_BYTES))


def builder(name: str = "latticeq", input_bytes: int = 0, cores: int = 8, **own: str) -> SparkSession.Builder:
    """A builder with the settings above; on a cluster name ``spark.checkpoint.dir`` as well."""
    b = SparkSession.builder.appName(name).config("spark.sql.shuffle.partitions", str(shuffle_partitions(input_bytes, cores)))
    for key, value in (SETTINGS | own).items():
        b = b.config(key, value)
    return b
