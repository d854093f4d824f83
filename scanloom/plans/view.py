"""Archive view of the test tables: order = study, order and supplier = series,
newest line item per (order, line) = instance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators.ordering import latest_per_key
from scanloom.plans.registry import table

VERSION = [
    "l_shipdate", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]

INSTANCE_COLUMNS = ["series_number", "modality"]


def text(col: str) -> Column:
    return F.col(col).cast("string")


def yyyymmdd(col: str) -> Column:
    return F.date_format(F.col(col), "yyyyMMdd")


def version_order() -> list[Column]:
    return [F.col(c) for c in VERSION]


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Received objects: one per line item."""
    return table(spark, folder, "lineitem")


def newest_lines(spark: SparkSession, folder: str) -> DataFrame:
    return latest_per_key(arrivals(spark, folder), ["l_orderkey", "l_linenumber"], version_order())


def with_instances(lines: DataFrame) -> DataFrame:
    """The lines with the columns of their instances beside their own."""
    return lines.select("*", *instance_columns())


def as_instances(lines: DataFrame) -> DataFrame:
    return lines.select(*instance_columns())


def instance_columns() -> list[Column]:
    return [
        F.concat(F.lit("1.2."), text("l_orderkey")).alias("study_uid"),
        F.concat(F.lit("1.2."), text("l_orderkey"), F.lit(".9."), text("l_suppkey")).alias("series_uid"),
        F.concat(F.lit("1.2."), text("l_orderkey"), F.lit("."), text("l_linenumber")).alias("sop_uid"),
        F.col("l_suppkey").alias("series_number"),
        F.col("l_linenumber").alias("instance_number"),
        F.col("l_returnflag").alias("modality"),
        F.col("l_quantity").cast("int").alias("n_frames"),
        yyyymmdd("l_shipdate").alias("content_date"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_linestatus").alias("line_status"),
    ]


def instances(spark: SparkSession, folder: str) -> DataFrame:
    return as_instances(newest_lines(spark, folder))


def studies(spark: SparkSession, folder: str) -> DataFrame:
    """Patient and study attributes: orders with their customer."""
    o = table(spark, folder, "orders")
    c = table(spark, folder, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.concat(F.lit("1.2."), text("o_orderkey")).alias("study_uid"),
        yyyymmdd("o_orderdate").alias("study_date"),
        F.col("o_orderpriority").alias("accession"),
        F.col("o_orderstatus").alias("study_status"),
        text("c_custkey").alias("patient_id"),
        F.col("c_name").alias("patient_name"),
        F.col("c_mktsegment").alias("description"),
    )


def instances_in_studies(spark: SparkSession, folder: str) -> DataFrame:
    """Instances of known studies with their patient and study attributes.

    Lines meet their study as they are; what is made from them is made after that and does not travel.
    """
    lines = newest_lines(spark, folder).withColumn("study_uid", instance_columns()[0])
    narrow = lines.select("study_uid", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity", "l_shipdate", "l_partkey", "l_linestatus")
    met = narrow.join(studies(spark, folder), "study_uid")
    uids = [
        F.concat("study_uid", F.lit(".9."), text("l_suppkey")).alias("series_uid"),
        F.concat("study_uid", F.lit("."), text("l_linenumber")).alias("sop_uid"),
    ]
    study = ["study_date", "accession", "study_status", "patient_id", "patient_name", "description"]
    return met.select("study_uid", *uids, *instance_columns()[3:], *study)


# The same view in SQL, as common table expressions for the comparison queries.
SQL_LINES = """
lines AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY
      l_shipdate DESC, l_suppkey DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC,
      l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rk
    FROM lineitem) WHERE rk = 1)"""

SQL_AS_INSTANCES = """
  SELECT '1.2.' || l_orderkey AS study_uid,
         '1.2.' || l_orderkey || '.9.' || l_suppkey AS series_uid,
         '1.2.' || l_orderkey || '.' || l_linenumber AS sop_uid,
         l_suppkey AS series_number, l_linenumber AS instance_number, l_returnflag AS modality,
         CAST(l_quantity AS INTEGER) AS n_frames, strftime(l_shipdate, '%Y%m%d') AS content_date,
         l_partkey AS part_key, l_linestatus AS line_status
  FROM """

SQL_INSTANCES = SQL_LINES + ",\ninstances AS (" + SQL_AS_INSTANCES + "lines)"

SQL_STUDIES = """
studies AS (
  SELECT '1.2.' || o_orderkey AS study_uid, strftime(o_orderdate, '%Y%m%d') AS study_date,
         o_orderpriority AS accession, o_orderstatus AS study_status,
         CAST(c_custkey AS VARCHAR) AS patient_id, c_name AS patient_name, c_mktsegment AS description
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

SQL_SERIES = """
series AS (
  SELECT study_uid, series_uid, min(series_number) AS series_number,
         arg_min(modality, instance_number) AS modality, count(*) AS n_instances
  FROM instances GROUP BY study_uid, series_uid)"""

SQL_STUDY_ROWS = """
study_rows AS (
  SELECT study_uid, sum(n_series)::BIGINT AS n_series, sum(n_instances)::BIGINT AS n_instances,
         string_agg(modality, ',' ORDER BY seen, seen_uid) AS modalities
  FROM (SELECT study_uid, modality, count(*) AS n_series, sum(n_instances) AS n_instances,
               min(series_number) AS seen, arg_min(series_uid, (series_number, series_uid)) AS seen_uid
        FROM series GROUP BY study_uid, modality)
  GROUP BY study_uid)"""
