"""Batch-versioned tables in the shared folder: ``<root>/<table>/batch=<id>``.

A micro-batch that is run again overwrites its own folder, so every table write is
idempotent. Readers name the last batch they want to see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.sources.documents import _existing


def write_batch(df: DataFrame, root: str, table: str, batch_id: int, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition)
    writer.parquet(f"{root}/{table}/batch={batch_id}")


def read_batches(
    spark: SparkSession, root: str, table: str, schema: str | T.StructType, last: int | None = None
) -> DataFrame:
    """All rows of a table with their ``batch`` number; empty when nothing was written yet."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType(list(fields.fields) + [T.StructField("batch", T.LongType())])
    path = f"{root}/{table}"
    if not _existing(spark, [path]):
        return spark.createDataFrame([], full)
    df = spark.read.schema(full).parquet(path)
    return df if last is None else df.where(F.col("batch") <= last)
