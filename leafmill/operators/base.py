"""Checkpoints and sizes that operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the folder in spark.checkpoint.dir (beside the warehouse where that is unset) and read from there: lineage ends, and a lost executor costs nothing."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-checkpoints"
    path = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a side that may be broadcast.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, rows: int) -> bool:
    """Whether a table has so many rows at most; reads no more than it has to."""
    return df.limit(rows + 1).count() <= rows
