"""Writing the archive: instance documents, bulk data, XML, export manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.nested import parsed, xml_lines
from scanloom.functions.paths import archive_path, bulk_path
from scanloom.session import settle

# Opening and closing lines of the XML document.
XML_HEAD = "\n".join([
    '<?xml version="1.0" encoding="utf-8" ?>',
    '<NativeDicomModel xmlns="http://dicom.nema.org/PS3.19/models/NativeDICOM" ',
    ' xsi:schemaLocation="http://dicom.nema.org/PS3.19/models/NativeDICOM" ',
    ' xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">',
])
XML_TAIL = "</NativeDicomModel>"


def study_bucket(study: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(study), F.lit(buckets)).cast("int")


#: Columns that are looked up by themselves; their order in the files says nothing about where a value lies.
LOOKED_UP = ("series_uid", "sop_uid")


def with_bloom_filters(writer, columns: Sequence[str]):
    """Bloom filters, sized by what a row group holds, that let a look-up by value skip the row groups without it."""
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer.option("parquet.bloom.filter.adaptive.enabled", "true") if columns else writer


def write_archive(
    instances: DataFrame, path: str, fmt: str = "parquet", buckets: int = 64, mode: str = "overwrite",
    looked_up: Sequence[str] = LOOKED_UP,
) -> None:
    """Instance rows in bucket folders, few large compressed files per bucket.

    Rows are range-partitioned by (bucket, study, series, object): a bucket goes to few
    tasks, and a bucket or study with very many rows is split over several of them.
    Parquet files get Bloom filters of the ``looked_up`` columns.
    """
    rows = instances.withColumn("study_bucket", study_bucket(F.col("study_uid"), buckets))
    keys = [k for k in ("study_bucket", "study_uid", "series_uid", "sop_uid") if k in rows.columns]
    writer = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).partitionBy("study_bucket")
    if fmt == "json":
        writer.option("compression", "gzip").json(path)
    else:
        writer = with_bloom_filters(writer, [c for c in looked_up if c in rows.columns])
        writer.option("compression", "zstd").parquet(path)


def read_archive(spark, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path) if fmt == "json" else reader.parquet(path)


def read_study(archive: DataFrame, study_uid: str, buckets: int = 64) -> DataFrame:
    """Rows of one study: its bucket prunes folders, the UID prunes row groups."""
    bucket = study_bucket(F.lit(study_uid), buckets)
    return archive.where((F.col("study_bucket") == bucket) & (F.col("study_uid") == study_uid))


def find_objects(archive: DataFrame, uids: Sequence[str], column: str = "sop_uid") -> DataFrame:
    """Rows of the given UIDs, a handful, without knowing their study: row groups without one of them are skipped."""
    wanted = F.lit(False)
    for uid in uids:
        wanted = wanted | (F.col(column) == uid)
    return archive.where(wanted)


def bulkdata_rows(df: DataFrame, content: str, keeper: str, layout: tuple[int, int] = (2, 2)) -> DataFrame:
    """Distinct contents with hash, size, path and number of users; copies combine before the shuffle."""
    hashed = df.select(F.sha2(F.col(content), 256).alias("hash"), F.col(content).alias("content"), keeper)
    rows = hashed.groupBy("hash").agg(
        F.any_value("content").alias("content"),
        F.min(keeper).alias("first_user"),
        F.count(F.lit(1)).alias("n_users"),
    )
    return rows.select(
        "hash", "content", F.octet_length("content").cast("bigint").alias("size"), "first_user", "n_users",
        bulk_path(F.col("hash"), layout).alias("path"),
    )


def write_bulkdata(rows: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """Append contents that are not stored yet, in 256 hash-prefix folders."""
    if existing is not None:
        rows = rows.join(existing.select("hash"), "hash", "left_anti")
    placed = rows.withColumn("prefix", F.substring("hash", 1, 2))
    placed.repartitionByRange("hash").write.mode("append").partitionBy("prefix").parquet(path)


def chunk_rows(df: DataFrame, value: str, content: str, chunk_bytes: int) -> DataFrame:
    """Values as ordered chunks ``(value, part, content)``; an empty value is one empty chunk, a NULL one has none."""
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(content) / chunk_bytes) - 1).cast("int")
    rows = df.where(F.col(content).isNotNull()).select(value, F.col(content).cast("binary").alias("_all"), F.explode(F.sequence(F.lit(0), last)).alias("part"))
    return rows.select(value, "part", F.substring("_all", F.col("part") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("content"))


def chunked_digests(chunks: DataFrame, value: str) -> DataFrame:
    """``(value, hash, size, n_parts)`` of values given as chunks ``(value, part, content)``, the hash over all of them in order.

    The chunks of a value run through one task in order, which holds the hash's state and one batch of rows; a value may be
    larger than a row or a task's memory. Rows without a value id take no part.
    """
    rows = chunks.where(F.col(value).isNotNull()).select(value, "part", F.col("content").cast("binary").alias("content"))
    ordered = rows.repartition(value).sortWithinPartitions(value, "part")
    kind = rows.schema[value].dataType.simpleString()

    def run(batches):
        own, state, size, parts = None, None, 0, 0
        for batch in batches:
            out, target = [], batch.schema.field(0).type
            for v, c in zip(batch.column(0).to_pylist(), batch.column(2)):
                if state is None or v != own:
                    if state is not None:
                        out.append((own, state.hexdigest(), size, parts))
                    own, state, size, parts = v, hashlib.sha256(), 0, 0
                data = c.as_buffer()
                if data is not None:
                    state.update(data)
                    size += data.size
                parts += 1
            if out:
                yield table(out, target)
        if state is not None:
            yield table([(own, state.hexdigest(), size, parts)], target)

    def table(rows, target):
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (target, pa.string(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=[value, "hash", "size", "n_parts"])

    return ordered.mapInArrow(run, f"`{value}` {kind}, hash string, size bigint, n_parts bigint")


def chunked_bulkdata(chunks: DataFrame, value: str, layout: tuple[int, int] = (2, 2)) -> tuple[DataFrame, DataFrame]:
    """``(contents, stored)``: one row per distinct content, and the chunks ``(hash, part, content)`` of its first user.

    Only digests are grouped. Chunks are joined with the few columns of the values that are kept, so equal values are
    stored once and no content passes through an aggregation.
    """
    digests = settle(chunked_digests(chunks, value))
    contents = digests.groupBy("hash").agg(
        F.max("size").alias("size"), F.max("n_parts").alias("n_parts"), F.min(value).alias("first_user"), F.count(F.lit(1)).alias("n_users")
    )
    contents = settle(contents.withColumn("path", bulk_path(F.col("hash"), layout)))
    keepers = contents.select(F.col("first_user").alias(value), "hash")
    return contents, chunks.join(keepers, value).select("hash", "part", "content")


def write_chunks(stored: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """Append chunks of contents that are not stored yet, in 256 hash-prefix folders, a content's chunks in order."""
    if existing is not None:
        stored = stored.join(existing.select("hash").distinct(), "hash", "left_anti")
    placed = stored.withColumn("prefix", F.substring("hash", 1, 2))
    sorted_rows = placed.repartitionByRange("hash", "part").sortWithinPartitions("hash", "part")
    with_bloom_filters(sorted_rows.write.mode("append").partitionBy("prefix"), ["hash"]).parquet(path)


def read_chunks(spark, path: str, digest: str) -> DataFrame:
    """Chunks of one content in order."""
    rows = spark.read.schema("hash string, part int, content binary, prefix string").parquet(path)
    return rows.where((F.col("prefix") == digest[:2]) & (F.col("hash") == digest)).orderBy("part").select("part", "content")


def dataset_xml(document: Column, one_line: bool = False) -> Column:
    """Native-model XML of a VARIANT dataset, sequence items nested as deeply as they come.

    Built inside the row, in Arrow batches, without a shuffle. Markup characters in values are escaped, in the one-line
    form line breaks too.
    """
    head, end = (XML_HEAD.replace("\n", ""), "") if one_line else (XML_HEAD, "\n")

    @F.pandas_udf("string")
    def render(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: end.join([head, *xml_lines(parsed(t), one_line), XML_TAIL]))

    return F.when(document.isNotNull(), render(F.to_json(document)))


def write_xml(documents: DataFrame, column: str, path: str) -> None:
    """Text files with one XML document per line."""
    documents.select(dataset_xml(F.col(column), one_line=True).alias("value")).write.text(path)


def export_plan(
    instances: DataFrame, studies: DataFrame, series_uid: str | None = None, requested: DataFrame | None = None
) -> DataFrame:
    """Manifest of an export: what is written where, and what was asked for but is not there.

    ``studies(study_uid)`` chooses studies, ``series_uid`` one series, ``requested(study_uid,
    sop_uid)`` single objects. Failures stay in the manifest so that an export can go on.
    """
    rows = instances.join(studies.select("study_uid").distinct(), "study_uid", "left_semi")
    if series_uid:
        rows = rows.where(F.col("series_uid") == series_uid)
    target = F.concat(archive_path(F.col("study_uid"), F.col("series_uid"), F.col("sop_uid")), F.lit(".dcm"))
    rows = rows.select("study_uid", "series_uid", "sop_uid", target.alias("target"))
    if requested is None:
        return rows.withColumn("status", F.lit("export"))
    asked = requested.select("study_uid", "sop_uid").distinct()
    joined = asked.join(rows, ["study_uid", "sop_uid"], "left")
    return joined.select(
        "study_uid", "series_uid", "sop_uid", "target",
        F.when(F.col("target").isNull(), "missing").otherwise("export").alias("status"),
    )
