"""Files as they arrive: the same parsing as a stream, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.tables import objects, optimized

_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """doc_id, content of files that arrive in a folder; each file once."""
    stream = spark.readStream.format("binaryFile").schema(_SCHEMA).option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.select(F.col("path").alias("doc_id"), "content", "length")


def object_stream(spark: SparkSession, folder: str) -> DataFrame:
    return objects(arriving(spark, folder))


def optimized_stream(spark: SparkSession, folder: str) -> DataFrame:
    return optimized(arriving(spark, folder))
