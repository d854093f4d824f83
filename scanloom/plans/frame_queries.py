"""Queries of frames, transfer syntaxes and pixel statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import frames as R
from scanloom.plans import view as V
from scanloom.plans.registry import query, table

SYNTAX_SQL = """CASE p_type WHEN 'SMALL' THEN '1.2.840.10008.1.2' WHEN 'PROMO' THEN '1.2.840.10008.1.2.4.80'
  WHEN 'LARGE' THEN '1.2.840.10008.1.2.4.50' WHEN 'ECONOMY' THEN '1.2.840.10008.1.2.4.102'
  WHEN 'STANDARD' THEN '1.2.840.10008.1.2.5' ELSE '9.9.9' END"""


def part_syntax():
    return F.expr(SYNTAX_SQL)


@query("frame_rows", f"""WITH {V.SQL_INSTANCES},
f AS (SELECT sop_uid, modality, unnest(range(1, n_frames + 1)) AS frame_no FROM instances)
SELECT sop_uid, frame_no::INTEGER AS frame_no, 'frames/' || frame_no || CASE modality WHEN 'A' THEN '.mht.gz' ELSE '.mht' END AS file_name,
  CASE modality WHEN 'A' THEN 'application/octet-stream;transfer-syntax=1.2.840.10008.1.2.1'
    WHEN 'R' THEN 'image/jls;transfer-syntax=1.2.840.10008.1.2.4.80' ELSE 'application/octet-stream' END AS part_type FROM f""")
def frame_rows(spark, folder):
    syntax = F.when(F.col("modality") == "A", "1.2.840.10008.1.2").when(F.col("modality") == "R", "1.2.840.10008.1.2.4.80")
    inst = V.instances(spark, folder).withColumn("transfer_syntax", syntax)
    return R.frame_rows(inst, ["sop_uid"])


@query("transfer_syntax_dim", """
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'image/jls' WHEN 'LARGE' THEN 'image/jpeg' WHEN 'STANDARD' THEN 'image/dicom-rle'
  ELSE 'application/octet-stream' END AS content_type,
  CASE p_type WHEN 'PROMO' THEN '.jls' WHEN 'LARGE' THEN '.jpeg' END AS extension,
  p_type = 'SMALL' AS gzip, p_type = 'LARGE' AS lossy, p_type = 'SMALL' AS uncompressed,
  CASE p_type WHEN 'ECONOMY' THEN 'mp4' END AS video_type FROM part""")
def transfer_syntax_dim(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", part_syntax().alias("transfer_syntax"))
    return R.with_transfer_syntax(part).drop("transfer_syntax")


@query("transcode_plan", f"""
WITH i AS (SELECT p_partkey, p_type, CASE WHEN p_size < 20 THEN 3 ELSE 1 END AS samples,
  CASE p_brand WHEN 'Brand#1' THEN 1 ELSE 0 END AS planar, CASE p_brand WHEN 'Brand#2' THEN 'PALETTE COLOR' ELSE 'RGB' END AS photo,
  {SYNTAX_SQL} AS src FROM part)
SELECT p_partkey, CASE WHEN planar = 1 OR photo = 'PALETTE COLOR' THEN 'copy'
    WHEN p_type = 'SMALL' THEN 'transcode' WHEN p_type = 'STANDARD' AND samples = 1 THEN 'transcode' ELSE 'copy' END AS op,
  CASE WHEN planar = 1 OR photo = 'PALETTE COLOR' THEN src WHEN p_type = 'SMALL' AND samples = 1 OR p_type = 'STANDARD' AND samples = 1 THEN '1.2.840.10008.1.2.4.80'
    WHEN p_type = 'SMALL' THEN '1.2.840.10008.1.2.4.201' ELSE src END AS available_syntax FROM i""")
def transcode_plan(spark, folder):
    size, brand = F.col("p_size"), F.col("p_brand")
    images = table(spark, folder, "part").select(
        "p_partkey",
        part_syntax().alias("transfer_syntax"),
        F.when(size < 20, 3).otherwise(1).alias("samples"),
        F.when(brand == "Brand#1", 1).otherwise(0).alias("planar"),
        F.when(brand == "Brand#2", "PALETTE COLOR").otherwise("RGB").alias("photometric"),
        F.lit(None).cast("string").alias("target_syntax"),
    )
    plan = R.transcode_plan(images, grey="jls", color="jhc", recompress=["uncompressed", "rle"], recompress_color=["uncompressed"])
    return plan.select("p_partkey", "op", "available_syntax")


@query("frame_min_max", """
SELECT vec_id, CAST(list_min(embedding) AS DOUBLE) AS min, CAST(list_max(embedding) AS DOUBLE) AS max FROM embeddings""")
def frame_min_max(spark, folder):
    mm = R.min_max(F.col("embedding"))
    return table(spark, folder, "embeddings").select("vec_id", mm.alias("m")).select(
        "vec_id", F.col("m.min").cast("double").alias("min"), F.col("m.max").cast("double").alias("max")
    )


@query("series_min_max", """
SELECT label, CAST(min(list_min(embedding)) AS DOUBLE) AS min, CAST(max(list_max(embedding)) AS DOUBLE) AS max FROM embeddings GROUP BY label""")
def series_min_max(spark, folder):
    out = R.series_range(table(spark, folder, "embeddings"), ["label"], "embedding")
    return out.select("label", F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"))


@query("default_window", """
WITH m AS (SELECT vec_id, label, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi FROM embeddings)
SELECT vec_id, CASE WHEN label = 0 THEN 256 ELSE (hi * 2 - 1) - (lo * 2 - 1) + 1 END::DOUBLE AS width,
  CASE WHEN label = 0 THEN 128 ELSE ((hi * 2 - 1) + (lo * 2 - 1) + 1) / 2 END::DOUBLE AS center FROM m""")
def default_window(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "label", R.min_max(F.col("embedding")).alias("m"))
    window = R.default_window(
        F.col("m.min").cast("double"), F.col("m.max").cast("double"), F.lit(2.0), F.lit(-1.0), F.col("label") == 0
    )
    return e.select("vec_id", window.alias("w")).select("vec_id", "w.*")


@query("quantize_uint16", """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS px FROM embeddings),
s AS (SELECT vec_id, px, list_min(px) AS lo, (list_max(px) - list_min(px)) / 65535 AS slope FROM x),
q AS (SELECT vec_id, slope, lo AS intercept, list_transform(px, lambda v: CAST(floor((v - lo) / slope) AS INTEGER)) AS vals FROM s)
SELECT vec_id, round(slope, 12) AS slope, round(intercept, 12) AS intercept, array_to_string(vals, ',') AS values,
  list_min(vals) AS min, list_max(vals) AS max FROM q""")
def quantize_uint16(spark, folder):
    q = table(spark, folder, "embeddings").select("vec_id", R.quantize(F.col("embedding")).alias("q"))
    return q.select(
        "vec_id", F.round("q.slope", 12).alias("slope"), F.round("q.intercept", 12).alias("intercept"),
        F.array_join("q.values", ",").alias("values"), F.col("q.min").alias("min"), F.col("q.max").alias("max"),
    )
