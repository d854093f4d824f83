"""Reading document files: JSON datasets, NDJSON results, multipart bulk data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions.paths import is_input_name, key_to_file
from scanloom.model import DATASET_TYPE
from scanloom.sources.files import list_tree, multipart_headers, read_contents, read_ranges, texts_of


def _existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The given root paths that exist; a handful of names, not a listing."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            found.append(path)
    return found


def scan_files(spark: SparkSession, paths: str | Sequence[str], with_content: bool = False) -> DataFrame:
    """Files below the given paths without hidden and resource-fork entries.

    Missing roots are skipped. Without ``with_content`` the bytes are never read. Folders are listed in tasks, level by
    level (see :func:`scanloom.sources.files.list_tree`).
    """
    files = list_tree(spark, paths).select("path", "modificationTime", "length")
    return read_contents(files) if with_content else files


def input_files(spark: SparkSession, paths: str | Sequence[str], check_names: bool = True) -> DataFrame:
    files = scan_files(spark, paths)
    return files.where(is_input_name(F.col("path"))) if check_names else files


def list_objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Object listing of a store: key, size, relative URI and file name of every object below ``prefix``.

    ``prefix`` is a folder of the store and ends in a slash; the relative URI is the key without it.
    """
    files = list_tree(spark, f"{root.rstrip('/')}/{prefix}" if prefix else root)
    objects = files.select(F.concat(F.lit(prefix), "relative").alias("key"), F.col("length").alias("size"), "modificationTime")
    return as_listing(objects, lambda key: key_to_file(key, prefix), prefix)


def as_listing(objects: DataFrame, to_file, prefix: str = "") -> DataFrame:
    """Add ``relative_uri`` and ``file_name`` to ``(key, size, ...)``."""
    relative = F.substr("key", F.lit(len(prefix) + 1))
    return objects.select("*", relative.alias("relative_uri"), to_file(F.col("key")).alias("file_name"))


def parse_documents(df: DataFrame, text: str) -> DataFrame:
    """Add ``document`` (VARIANT, NULL when the text is not JSON) and ``ok``."""
    parsed = df.withColumn("document", F.try_parse_json(text))
    return parsed.withColumn("ok", F.col("document").isNotNull())


def split_documents(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(readable, quarantined)``; input files are never deleted."""
    return parsed.where("ok").drop("ok"), parsed.where("NOT ok").drop("ok", "document")


def read_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per JSON file, plain or ``.gz``, with its document as VARIANT; unreadable files are not ``ok``."""
    files = read_contents(scan_files(spark, path))
    return parse_documents(files.select("path", texts_of(F.col("path"), F.col("content")).alias("text")), "text")


def as_datasets(documents: DataFrame, column: str = "document") -> DataFrame:
    """VARIANT documents to dataset maps: one row per element of an array document."""
    many = F.try_variant_get(column, "$", "array<variant>")
    single = F.when(many.isNull(), F.array(F.col(column))).otherwise(many)
    kept = [c for c in documents.columns if c != column]
    rows = documents.select(*kept, F.explode_outer(single).alias("_doc")).where("_doc IS NOT NULL")
    return rows.select(*kept, F.from_json(F.to_json("_doc"), DATASET_TYPE).alias("ds"))


NDJSON_RESULT = "importResponse struct<imageSetId:string>"


def read_import_results(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Distinct image set ids of an import job's NDJSON result files."""
    rows = spark.read.schema(NDJSON_RESULT).json(path)
    return image_set_ids(rows)


def image_set_ids(rows: DataFrame, *keys: str) -> DataFrame:
    return (
        rows.select(*keys, F.col("importResponse.imageSetId").alias("image_set_id"))
        .where("image_set_id IS NOT NULL")
        .distinct()
    )


def multipart_fields(content: Column) -> Column:
    """Separator, content type, transfer syntax and payload of a multipart file.

    Bytes map one to one onto ISO-8859-1 characters, so positions in the text are byte
    positions. Content that does not start with ``--`` is one octet stream.
    """
    text = F.decode(content, "ISO-8859-1")
    multipart = text.startswith("--")
    separator = F.substring_index(text, "\r\n", 1)
    head_end = F.locate("\r\n\r\n", text)
    header = F.substr(text, F.length(separator) + 1, head_end - F.length(separator))
    line = F.regexp_extract(header, r"(?:^|\n)(Content-Type[^\r\n]*)", 1)
    kind = F.trim(F.regexp_extract(F.substr(line, F.lit(15)), "^([^;]*)", 1))
    syntax = F.trim(F.regexp_extract(line, "transfer-syntax=([^;]*)", 1))
    start = head_end + 4
    stop = F.length(text) - F.length(separator) - 6
    body = F.encode(F.substr(text, start, F.greatest(stop - start + 1, F.lit(0))), "ISO-8859-1")
    octets = "application/octet-stream"
    return F.struct(
        F.when(multipart, separator).alias("separator"),
        F.when(multipart & (line != ""), kind).otherwise(octets).alias("content_type"),
        F.when(multipart, F.nullif(syntax, F.lit(""))).alias("transfer_syntax"),
        F.when(multipart, body).otherwise(content).alias("payload"),
    )


def read_multipart(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All bulk data files below ``path`` with their whole payload, for payloads that fit a row.

    Header and payload are read by their places in the file. :func:`scanloom.sources.files.payload_slices` gives large
    payloads in slices.
    """
    headers = multipart_headers(scan_files(spark, path))
    whole = read_ranges(headers, "payload_start", "payload_size")
    return whole.select("path", "separator", "content_type", "transfer_syntax", F.col("content").alias("payload"))
