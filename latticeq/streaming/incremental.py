"""Incremental ingest, an extension: new files of a folder, each content once, as a stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..sources.files import SUFFIXES

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, root: str, watermark: str = "30 days") -> DataFrame:
    """``path, modificationTime, length, md5`` of image files as they come, without contents repeated within a time.

    State is kept for the watermark's span of modification times only, so that it does not grow without end; what
    comes again later is told apart by :func:`append_to`, from the stored digests.
    """
    rows = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(root)
    rows = rows.where(ingest.suffix(F.col("path")).isin(*SUFFIXES)).select("path", "modificationTime", "length", F.md5("content").alias("md5"))
    return rows.withWatermark("modificationTime", watermark).dropDuplicatesWithinWatermark(["md5"])


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has come so far and stop; run again for what comes later. Each content is stored once.

    A batch leaves out digests that are stored already, so a batch that is run again after a loss adds nothing twice.
    """

    def store(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["md5"])
        try:
            new = new.join(batch.sparkSession.read.parquet(path).select("md5"), "md5", "left_anti").select(batch.columns)
        except AnalysisException as e:  # nothing stored yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
