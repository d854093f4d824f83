"""Queries of the roll-up, ordering and navigation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import hierarchy as H
from scanloom.operators import ordering as O
from scanloom.operators import rollup as R
from scanloom.operators.stored import CELL
from scanloom.plans import view as V
from scanloom.plans.registry import query, table
from scanloom.session import new_folder, settle, settle_bucketed
from scanloom.sources import sinks as K

WITH_SERIES = f"WITH {V.SQL_INSTANCES},{V.SQL_SERIES}"


def joined(col):
    return F.array_join(F.col(col), ",").alias(col)


def series_of(spark, folder):
    return H.series_summary(V.instances(spark, folder), V.INSTANCE_COLUMNS)


@query("latest_per_key", f"""
WITH {V.SQL_LINES}
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_returnflag, l_linestatus,
       strftime(l_shipdate, '%Y%m%d') AS shipped
FROM lines""")
def latest_per_key(spark, folder):
    return V.newest_lines(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_returnflag",
        "l_linestatus", V.yyyymmdd("l_shipdate").alias("shipped"),
    )


@query("series_summary", f"{WITH_SERIES} SELECT * FROM series")
def series_summary(spark, folder):
    return series_of(spark, folder)


@query("series_instances", f"""
WITH {V.SQL_INSTANCES}
SELECT study_uid, series_uid, sop_uid, instance_number, content_date,
       row_number() OVER (PARTITION BY study_uid, series_uid ORDER BY instance_number, sop_uid) AS position
FROM instances""")
def series_instances(spark, folder):
    return H.series_instances(V.instances(spark, folder), ["content_date"])


@query("study_summary", f"{WITH_SERIES},{V.SQL_STUDY_ROWS} SELECT * FROM study_rows")
def study_summary(spark, folder):
    return H.study_summary(series_of(spark, folder)).withColumn("modalities", F.array_join("modalities", ","))


@query("studies_index", f"""
{WITH_SERIES},{V.SQL_STUDY_ROWS},{V.SQL_STUDIES}
SELECT * FROM study_rows LEFT JOIN (SELECT * FROM studies WHERE study_uid NOT LIKE '%3') USING (study_uid)
ORDER BY study_date, study_uid""")
def studies_index(spark, folder):
    """Some studies have no attribute row; they stay in the index."""
    attributes = V.studies(spark, folder).where("study_uid NOT LIKE '%3'")
    index = H.studies_index(V.instances(spark, folder), attributes, V.INSTANCE_COLUMNS)
    return index.withColumn("modalities", F.array_join("modalities", ","))


@query("first_instance", f"""
WITH {V.SQL_INSTANCES}
SELECT study_uid, series_uid, sop_uid, n_frames, content_date FROM instances
QUALIFY row_number() OVER (PARTITION BY study_uid
                           ORDER BY series_number, series_uid, instance_number, sop_uid) = 1""")
def first_instance(spark, folder):
    return H.first_instance(V.instances(spark, folder), ["series_uid", "sop_uid", "n_frames", "content_date"])


@query("tree_rollup", f"""
WITH {V.SQL_INSTANCES}
SELECT study_uid, sum(n_series)::BIGINT AS n_series, sum(n_instances)::BIGINT AS n_instances,
       sum(n_frames)::BIGINT AS n_frames, string_agg(modality, ',' ORDER BY seen) AS modalities
FROM (SELECT study_uid, modality, count(*) AS n_series, sum(n_instances) AS n_instances, sum(n_frames) AS n_frames, min(seen) AS seen
      FROM (SELECT study_uid, series_uid, arg_min(modality, (instance_number, sop_uid)) AS modality, count(*) AS n_instances, min((instance_number, sop_uid)) AS seen,
                   sum(CASE WHEN n_frames = 0 THEN 1 ELSE n_frames END) AS n_frames
            FROM instances GROUP BY study_uid, series_uid)
      GROUP BY study_uid, modality)
GROUP BY study_uid""")
def tree_rollup(spark, folder):
    """One partial document per instance, as large studies arrive in pieces; their order is that of the instances."""
    trees = V.instances(spark, folder).select(
        "study_uid", F.struct("instance_number", "sop_uid").alias("place"),
        F.create_map(
            "series_uid",
            F.struct("modality", F.create_map("sop_uid", F.struct("n_frames")).alias("instances")),
        ).alias("series"),
    )
    out = H.tree_rollup(trees, "place")
    return out.withColumn("modalities", F.array_join("modalities", ","))


@query("distinct_series", f"""
WITH {V.SQL_INSTANCES}
SELECT study_uid, series_uid, arg_min(sop_uid, instance_number) AS sop_uid,
       arg_min(modality, instance_number) AS modality
FROM instances GROUP BY study_uid, series_uid""")
def distinct_series(spark, folder):
    return H.distinct_series(V.instances(spark, folder), ["sop_uid", "modality"], H.instance_key())


@query("sort_studies", f"""
WITH {V.SQL_STUDIES}
SELECT study_uid, study_date, row_number() OVER (ORDER BY study_date, study_uid) AS ordinal FROM studies""")
def sort_studies(spark, folder):
    rows = V.studies(spark, folder).select("study_uid", "study_date", F.lit(None).cast("string").alias("study_time"))
    return O.with_ordinal(rows, [], O.study_order()).drop("study_time")


MIXED_SQL = """
mixed AS (
  SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN NULL
    WHEN p_brand = 'Brand#3' THEN '' WHEN p_type IN ('ECONOMY', 'SMALL') THEN CAST(p_size AS VARCHAR)
    WHEN p_type = 'LARGE' THEN CAST(p_retailprice AS VARCHAR) ELSE p_name END AS v FROM part)"""


@query("compare_key", f"""
WITH {MIXED_SQL}
SELECT p_partkey, v, dense_rank() OVER (ORDER BY
    CASE WHEN v IS NULL THEN 0 WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 1 WHEN v = '' THEN 2 ELSE 3 END,
    TRY_CAST(v AS DOUBLE) NULLS FIRST, CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN v END NULLS FIRST) AS position
FROM mixed""")
def compare_key(spark, folder):
    """Rank of each distinct value under the total order of mixed values."""
    part = table(spark, folder, "part")
    mixed = part.select(
        "p_partkey",
        F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), F.lit(None))
        .when(F.col("p_brand") == "Brand#3", "")
        .when(F.col("p_type").isin("ECONOMY", "SMALL"), F.col("p_size").cast("string"))
        .when(F.col("p_type") == "LARGE", F.col("p_retailprice").cast("string"))
        .otherwise(F.col("p_name"))
        .alias("v"),
    )
    key = O.compare_key(F.col("v"))
    distinct = mixed.select(key["rank"].alias("r"), key["num"].alias("n"), key["raw"].alias("t")).distinct()
    order = [F.col("r"), F.col("n").asc_nulls_first(), F.collate("t", "UNICODE").asc_nulls_first(), F.col("t")]
    ranked = O.with_ordinal(distinct, [], order, "position")
    m = mixed.select("*", key["rank"].alias("mr"), key["num"].alias("mn"), key["raw"].alias("mt"))
    same = (
        (m["mr"] == ranked["r"]) & m["mn"].eqNullSafe(ranked["n"]) & m["mt"].eqNullSafe(ranked["t"])
    )
    return m.join(ranked, same).select("p_partkey", "v", "position")


@query("sort_series", f"""
{WITH_SERIES}
SELECT study_uid, series_uid, row_number() OVER (PARTITION BY study_uid ORDER BY number NULLS LAST, series_uid)
  AS position FROM (SELECT *, CASE WHEN modality = 'R' THEN NULL ELSE series_number END AS number FROM series)""")
def sort_series(spark, folder):
    """Series with a missing number (here: modality R) come last."""
    number = F.when(F.col("modality") != "R", F.col("series_number"))
    rows = series_of(spark, folder).select(
        "study_uid", "series_uid", O.number_last_key(number, F.col("series_uid")).alias("k")
    )
    return O.with_ordinal(rows, ["study_uid"], [F.col("k")], "position").drop("k")


@query("middle_element", f"""
WITH {V.SQL_INSTANCES},
loose AS (SELECT * REPLACE (CASE WHEN part_key % 9 > 0 THEN series_uid END AS series_uid) FROM instances),
numbered AS (SELECT *, row_number() OVER (PARTITION BY study_uid, series_uid ORDER BY instance_number, sop_uid)
                AS position, count(*) OVER (PARTITION BY study_uid, series_uid) AS group_size FROM loose)
SELECT study_uid, series_uid, sop_uid, position, group_size,
       CAST(ceil((CASE WHEN n_frames = 0 THEN 1 ELSE n_frames END) / 2) AS BIGINT) AS middle_frame
FROM numbered WHERE position = group_size // 2 + 1""")
def middle_element(spark, folder):
    """Instances without a series are a group of their study."""
    series = F.when(F.col("part_key") % 9 > 0, F.col("series_uid"))
    rows = V.instances(spark, folder).select(
        "study_uid", series.alias("series_uid"), "sop_uid", "n_frames", H.instance_key().alias("k")
    )
    out = O.middle_element(rows, H.SERIES, [F.col("k")], "n_frames")
    return out.drop("k", "n_frames")


@query("index_position", """
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS number
FROM conversations""")
def index_position(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    order = [F.col("turn"), F.col("role"), F.col("text")]
    return O.with_ordinal(turns, ["conv_id"], order, "number").drop("text")


@query("invalidate_summaries", f"""
{WITH_SERIES}
SELECT study_uid, series_uid, n_instances FROM series s WHERE EXISTS (
  SELECT 1 FROM instances i WHERE i.series_uid = s.series_uid AND i.study_uid = s.study_uid
  AND i.content_date >= '20010101')""")
def invalidate_summaries(spark, folder):
    inst = V.instances(spark, folder)
    batch = inst.where(F.col("content_date") >= "20010101")
    return H.invalidate_summaries(series_of(spark, folder), batch).select("study_uid", "series_uid", "n_instances")


@query("rebuild_affected", f"""
{WITH_SERIES}
SELECT * FROM series s WHERE EXISTS (
  SELECT 1 FROM instances i WHERE i.series_uid = s.series_uid AND i.study_uid = s.study_uid
  AND i.content_date >= '20010101')""")
def rebuild_affected(spark, folder):
    inst = V.instances(spark, folder)
    return H.rebuild_affected(inst, inst.where(F.col("content_date") >= "20010101"), V.INSTANCE_COLUMNS)


ROLL_SQL = f"""
WITH {V.SQL_INSTANCES},
after AS (SELECT * REPLACE (CASE WHEN part_key % 7 = 3 THEN instance_number + 10 WHEN part_key % 7 = 4 THEN instance_number - 10 ELSE instance_number END AS instance_number,
                            CASE WHEN part_key % 7 IN (3, 4) THEN 'U' ELSE modality END AS modality)
          FROM instances WHERE part_key % 7 <> 2)"""


def rolled(spark, folder):
    """The state before, the changes, the instances after them: some are added, deleted, moved back or forward with a new modality.

    All lie in buckets by the cell of their series: the lines are moved there once, the others come from them in place.
    """
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The lines travel, a fraction of the instances' UIDs.
    lines = V.newest_lines(spark, folder)
    names = V.as_instances(lines).columns
    placed = R.with_series_cell(V.with_instances(lines)).select(*lines.columns, CELL).repartition(buckets, CELL)
    inst = settle_bucketed(V.with_instances(placed).select(*names, CELL), [CELL], buckets, placed=True)
    group = F.col("part_key") % 7
    number = F.col("instance_number") + F.when(group == 3, 10).when(group == 4, -10).otherwise(0)
    moved = inst.withColumns({"instance_number": number, "modality": F.when(group.isin(3, 4), "U").otherwise(F.col("modality"))})
    op = F.when(group == 1, R.INSERT).when(group == 2, R.DELETE).when(group.isin(3, 4), R.UPDATE)
    changes = moved.withColumn("op", op).where("op IS NOT NULL")
    state = settle_bucketed(R.series_state(inst.where(group != 1), V.INSTANCE_COLUMNS), [CELL], buckets, placed=True)
    return state, settle_bucketed(changes, [CELL], buckets, placed=True), moved.where(group != 2)


@query("rollup_series", f"""{ROLL_SQL}
SELECT study_uid, series_uid, min(series_number) AS series_number, arg_min(modality, (instance_number, sop_uid)) AS modality, count(*) AS n_instances
FROM after GROUP BY study_uid, series_uid""")
def rollup_series(spark, folder):
    """Kept up by a batch; the archive of the instances lies in study buckets and is read only for first instances that went."""
    state, changes, after = rolled(spark, folder)
    path = new_folder(spark, "archive")
    K.write_archive(after.drop(CELL), path, buckets=8)
    read = R.bucket_reader(K.read_archive(spark, path), lambda study: K.study_bucket(study, 8))
    return R.summaries(R.roll_up(state, changes, V.INSTANCE_COLUMNS, read))


@query("rollup_studies", f"""{ROLL_SQL},
series AS (SELECT study_uid, series_uid, min(series_number) AS series_number, arg_min(modality, (instance_number, sop_uid)) AS modality, count(*) AS n_instances
  FROM after GROUP BY study_uid, series_uid),{V.SQL_STUDY_ROWS}
SELECT study_uid, n_series, n_instances, modalities FROM study_rows WHERE study_uid IN (SELECT study_uid FROM instances WHERE part_key % 7 BETWEEN 1 AND 4)""")
def rollup_studies(spark, folder):
    state, changes, after = rolled(spark, folder)
    rows = R.touched_studies(R.roll_up(state, changes, V.INSTANCE_COLUMNS, R.reader_of(after)), changes)
    return rows.withColumn("modalities", F.array_join("modalities", ","))


@query("build_missing", f"{WITH_SERIES} SELECT * FROM series WHERE modality <> 'A'")
def build_missing(spark, folder):
    inst = V.instances(spark, folder)
    existing = series_of(spark, folder).where("modality = 'A'")
    return H.build_missing(inst, existing, V.INSTANCE_COLUMNS)


@query("set_consistency", f"""
WITH {V.SQL_INSTANCES},
s AS (SELECT DISTINCT '1.2.' || l_orderkey AS study_uid, '1.2.' || l_orderkey || '.9.' || l_suppkey AS series_uid
      FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-01-01'),
a AS (SELECT DISTINCT study_uid, series_uid FROM instances),
b AS (SELECT coalesce(s.study_uid, a.study_uid) AS study_uid, s.series_uid IS NULL AS missing,
             a.series_uid IS NULL AS extra
      FROM s FULL JOIN a ON s.study_uid = a.study_uid AND s.series_uid = a.series_uid)
SELECT study_uid, count(*) FILTER (missing) AS n_missing, count(*) FILTER (extra) AS n_extra,
       bool_and(NOT missing AND NOT extra) AS consistent FROM b GROUP BY study_uid""")
def set_consistency(spark, folder):
    """Series listed from early arrivals against the series of the newest instances."""
    early = V.arrivals(spark, folder).where(F.col("l_shipdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
    return H.set_consistency(V.as_instances(early), V.instances(spark, folder), ["study_uid"], "series_uid")


@query("set_differences", f"""
WITH {V.SQL_INSTANCES},
s AS (SELECT DISTINCT '1.2.' || l_orderkey AS study_uid, '1.2.' || l_orderkey || '.9.' || l_suppkey AS series_uid
      FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-01-01'),
a AS (SELECT DISTINCT study_uid, series_uid FROM instances)
SELECT coalesce(s.study_uid, a.study_uid) AS study_uid, coalesce(s.series_uid, a.series_uid) AS series_uid,
       CASE WHEN s.series_uid IS NULL THEN 'missing' ELSE 'extra' END AS side
FROM s FULL JOIN a ON s.study_uid = a.study_uid AND s.series_uid = a.series_uid
WHERE s.series_uid IS NULL OR a.series_uid IS NULL""")
def set_differences(spark, folder):
    early = V.arrivals(spark, folder).where(F.col("l_shipdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
    return H.set_differences(V.as_instances(early), V.instances(spark, folder), ["study_uid"], "series_uid")


@query("hierarchy_navigate", f"""
{WITH_SERIES},{V.SQL_STUDIES}
SELECT i.study_uid, i.series_uid, i.sop_uid, i.n_frames, s.n_instances, t.patient_name, t.study_date
FROM instances i JOIN series s ON i.study_uid = s.study_uid AND i.series_uid = s.series_uid
JOIN studies t ON i.study_uid = t.study_uid""")
def hierarchy_navigate(spark, folder):
    inst = V.instances(spark, folder).select("study_uid", "series_uid", "sop_uid", "n_frames")
    return H.navigate(
        V.studies(spark, folder), series_of(spark, folder), inst, ["patient_name", "study_date"], ["n_instances"]
    )
