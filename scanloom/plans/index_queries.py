"""Queries of index maintenance and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import consistency as C
from scanloom.operators import hierarchy as H
from scanloom.operators import indexing as I
from scanloom.operators.dedup import set_hash
from scanloom.operators.ordering import latest_per_key
from scanloom.plans import view as V
from scanloom.plans.dedup_queries import sql_set_hash
from scanloom.plans.registry import query, table
from scanloom.session import settle


def order_rows(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", V.yyyymmdd("o_orderdate").alias("study_date")
    )


@query("index_upsert", """
WITH r AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y%m%d') AS study_date FROM orders)
SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 300000 THEN 'U' ELSE o_orderstatus END AS o_orderstatus,
       o_totalprice, study_date FROM r WHERE o_orderstatus <> 'P' OR o_totalprice > 300000""")
def index_upsert(spark, folder):
    rows = order_rows(spark, folder)
    updates = rows.where("o_totalprice > 300000")
    old_and_new = updates.withColumn("v", F.lit(1)).unionByName(
        updates.withColumn("o_orderstatus", F.lit("U")).withColumn("v", F.lit(2))
    )
    return I.index_upsert(rows.where("o_orderstatus <> 'P'"), old_and_new, ["o_orderkey"], ["v"])


@query("index_purge", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
  OR o_orderstatus = 'P'""")
def index_purge(spark, folder):
    rows = order_rows(spark, folder)
    live = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    touched = rows.where("o_orderstatus = 'P'")
    return I.index_purge(rows, live, ["o_orderkey"], touched).select("o_orderkey", "o_orderstatus")


@query("concat_indexes", """
SELECT c_name AS patient_name, c_mktsegment AS description, CAST(NULL AS INTEGER) AS nation FROM customer
UNION ALL SELECT s_name, NULL, s_nationkey FROM supplier""")
def concat_indexes(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_name").alias("patient_name"), F.col("c_mktsegment").alias("description"))
    s = table(spark, folder, "supplier").select(F.col("s_name").alias("patient_name"), F.col("s_nationkey").alias("nation"))
    return I.concat_indexes(c, s)


@query("delete_study", f"""
WITH {V.SQL_INSTANCES},{V.SQL_STUDIES},
gone AS (SELECT study_uid FROM studies WHERE study_status = 'P')
SELECT study_uid, 'index' AS store FROM studies WHERE study_uid NOT IN (SELECT study_uid FROM gone)
UNION ALL SELECT study_uid, 'instances' FROM instances WHERE study_uid NOT IN (SELECT study_uid FROM gone)""")
def delete_study(spark, folder):
    studies = V.studies(spark, folder)
    left = I.delete_studies(
        {"index": studies.select("study_uid"), "instances": V.instances(spark, folder).select("study_uid")},
        studies.where("study_status = 'P'"),
    )
    return left["index"].withColumn("store", F.lit("index")).unionByName(
        left["instances"].withColumn("store", F.lit("instances"))
    )


@query("unique_values", "SELECT DISTINCT user_id FROM events")
def unique_values(spark, folder):
    return I.unique_values(table(spark, folder, "events"), "user_id")


@query("select_uids", f"""WITH {V.SQL_INSTANCES}
SELECT study_uid, sop_uid, n_frames FROM instances
WHERE study_uid IN (SELECT '1.2.' || o_orderkey FROM orders WHERE o_totalprice < 100000)""")
def select_uids(spark, folder):
    asked = order_rows(spark, folder).where("o_totalprice < 100000").select(
        F.concat(F.lit("1.2."), V.text("o_orderkey")).alias("study_uid")
    )
    return I.select_uids(V.instances(spark, folder), asked, ["study_uid"]).select("study_uid", "sop_uid", "n_frames")


@query("change_set", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'untouched'
  WHEN o_orderstatus = 'F' AND o_totalprice < 250000 THEN 'created'
  WHEN o_totalprice < 250000 THEN 'identical'
  WHEN o_orderstatus = 'F' THEN 'created'
  WHEN o_orderpriority = '2-HIGH' THEN 'updated-stale' ELSE 'updated' END AS status FROM orders
WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""")
def change_set(spark, folder):
    """Stored orders (all but status F) against a rewrite that changes the expensive ones."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    stored = o.where("o_orderstatus <> 'F'")
    before = stored.select("o_orderkey", F.lit(1).alias("version"))
    now = stored.select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1).alias("version"),
        I.row_hash("o_orderstatus", "o_totalprice").alias("content_hash"),
    )
    price = F.when(F.col("o_totalprice") >= 250000, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    written = o.where("o_orderpriority <> '1-URGENT'").withColumn("o_totalprice", price).select(
        "o_orderkey", I.row_hash("o_orderstatus", "o_totalprice").alias("content_hash")
    )
    return I.change_set(before, written, now, ["o_orderkey"])


@query("next_free_name", """
WITH taken AS (SELECT c_mktsegment || CASE WHEN c_nationkey = 0 THEN '' ELSE '-' || c_nationkey END AS name FROM customer
               WHERE c_nationkey <> 7 AND (c_nationkey <> 3 OR c_mktsegment = 'BUILDING')
                 AND (c_nationkey > 0 OR c_mktsegment <> 'MACHINERY')),
wanted AS (SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT r_name FROM region),
cand AS (SELECT name, n, name || CASE WHEN n = 0 THEN '' ELSE '-' || n END AS candidate FROM wanted, range(0, 100) t(n))
SELECT name, arg_min(candidate, n) FILTER (candidate NOT IN (SELECT name FROM taken)) AS free_name FROM cand GROUP BY name""")
def next_free_name(spark, folder):
    c = table(spark, folder, "customer")
    nation = F.col("c_nationkey")
    taken = c.where(
        "c_nationkey <> 7 AND (c_nationkey <> 3 OR c_mktsegment = 'BUILDING') "
        "AND (c_nationkey > 0 OR c_mktsegment <> 'MACHINERY')"
    ).select(F.concat("c_mktsegment", F.when(nation == 0, "").otherwise(F.concat(F.lit("-"), nation.cast("string")))).alias("name"))
    wanted = c.select(F.col("c_mktsegment").alias("name")).unionByName(
        table(spark, folder, "region").select(F.col("r_name").alias("name"))
    )
    return I.next_free_names(wanted, taken)


NEWEST = """QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_suppkey DESC,
  l_partkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1"""


def sql_index(name, lines):
    return f"""{name}_rows AS ({V.SQL_AS_INSTANCES} (SELECT * FROM ({lines}) {NEWEST})),
{name} AS (SELECT study_uid, count(DISTINCT series_uid) AS s, count(*) AS n,
  {sql_set_hash("sha256(sop_uid || '|' || content_date || '|' || n_frames)")} AS h FROM {name}_rows GROUP BY study_uid)"""


def content_index(lines):
    """Study rows with counts and a hash of what their instances hold."""
    inst = V.as_instances(latest_per_key(lines, ["l_orderkey", "l_linenumber"], V.version_order()))
    rows = H.study_summary(H.series_summary(inst, V.INSTANCE_COLUMNS))
    one = F.sha2(F.concat_ws("|", "sop_uid", "content_date", F.col("n_frames").cast("string")), 256)
    return rows.join(inst.groupBy("study_uid").agg(set_hash(one).alias("content")), "study_uid")


@query("consistency_round", f"""
WITH {sql_index("a", "SELECT * FROM lineitem")},
{sql_index("b", "SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01'")}
SELECT coalesce(a.study_uid, b.study_uid) AS study_uid, CASE WHEN a.study_uid IS NULL THEN 'missing'
  WHEN b.study_uid IS NULL THEN 'extra' WHEN a.s = b.s AND a.n = b.n AND a.h = b.h THEN 'identical' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.study_uid = b.study_uid""")
def consistency_round(spark, folder):
    """Merge the arrivals of two replicas, rebuild the index, compare with the early replica's index."""
    li = V.arrivals(spark, folder)
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    first, second = li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut)

    return I.consistency_round(first, second, content_index, ["study_uid"], ["n_series", "n_instances", "content"])


@query("replicas_consistent", f"""
WITH {sql_index("a", "SELECT * FROM lineitem")},
{sql_index("b", "SELECT * FROM lineitem WHERE l_linestatus <> 'O' UNION ALL SELECT * FROM lineitem WHERE l_linestatus = 'O'")}
SELECT count(*) FILTER (a.n IS DISTINCT FROM b.n OR a.s IS DISTINCT FROM b.s OR a.h IS DISTINCT FROM b.h) AS n_uploads,
       count(*) FILTER (a.n IS DISTINCT FROM b.n OR a.s IS DISTINCT FROM b.s OR a.h IS DISTINCT FROM b.h) = 0 AS consistent
FROM a FULL JOIN b ON a.study_uid = b.study_uid""")
def replicas_consistent(spark, folder):
    """Two replicas that received everything in a different grouping agree."""
    li = V.arrivals(spark, folder)
    halves = li.where("l_linestatus = 'O'").unionByName(li.where("l_linestatus <> 'O'"))

    return I.consistent(
        I.replica_differences(content_index(li), content_index(halves), ["study_uid"], ["n_series", "n_instances", "content"])
    )


@query("replica_other_contents", f"""
WITH {sql_index("a", "SELECT * FROM lineitem")},
odd AS (SELECT DISTINCT study_uid FROM a_rows WHERE n_frames = 7)
SELECT a.study_uid, CASE WHEN odd.study_uid IS NULL THEN 'identical' ELSE 'changed' END AS status FROM a LEFT JOIN odd ON a.study_uid = odd.study_uid""")
def replica_other_contents(spark, folder):
    """A replica with the same counts and other contents is not identical."""
    li = V.arrivals(spark, folder)
    other = li.withColumn("l_quantity", F.when(F.col("l_quantity") == 7, 8).otherwise(F.col("l_quantity")).cast(li.schema["l_quantity"].dataType))
    return I.replica_differences(content_index(li), content_index(other), ["study_uid"], ["n_series", "n_instances", "content"])


CONSISTENT_SQL = f"""
WITH obj AS (SELECT l_orderkey AS k, l_linenumber AS i, max(epoch_us(l_shipdate)) AS v FROM lineitem GROUP BY ALL),
a AS (SELECT k, i, v FROM obj WHERE NOT (k % 50 = 1 AND i = 1)),
b AS (SELECT k, i, CASE WHEN k % 50 = 2 THEN v - 1 ELSE v END AS v FROM obj WHERE NOT (k % 50 = 3 AND i = 2)),
met AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.i, b.i) AS i, a.v AS av, b.v AS bv FROM a FULL JOIN b ON a.k = b.k AND a.i = b.i),
late AS (SELECT k, i FROM obj WHERE k % 70 = 5)
SELECT 1 AS round, count(DISTINCT k) AS n_studies, count(*) FILTER (av IS NULL OR av < bv) AS to_left, count(*) FILTER (bv IS NULL OR bv < av) AS to_right
FROM met WHERE av IS DISTINCT FROM bv
UNION ALL SELECT 2, count(DISTINCT k), 0, count(*) FROM late UNION ALL SELECT 3, 0, 0, 0"""


@query("consistency_loop", CONSISTENT_SQL)
def consistency_loop(spark, folder):
    """Each replica lacks some objects and one has old versions; more arrive during the first round. The rounds until both agree."""
    at = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    lines = V.arrivals(spark, folder).groupBy("l_orderkey", "l_linenumber").agg(F.max(at).alias("version"))
    objects = settle(lines.select(
        F.concat(F.lit("1.2."), V.text("l_orderkey")).alias("study_uid"), F.concat(F.lit("1.2."), V.text("l_orderkey"), F.lit("."), V.text("l_linenumber")).alias("sop_uid"),
        "version", F.sha2(V.text("l_linenumber"), 256).alias("content_hash"), (F.col("l_orderkey") % 50).alias("part"), (F.col("l_orderkey") % 70).alias("late"),
        F.col("l_linenumber").alias("line"),
    ))
    columns = ["study_uid", "sop_uid", "version", "content_hash"]
    old = F.when(F.col("part") == 2, F.col("version") - 1).otherwise(F.col("version"))
    left = C.Replica(objects.where("NOT (part = 1 AND line = 1)").select(*columns), ["sop_uid"])
    right = C.Replica(objects.where("NOT (part = 3 AND line = 2)").withColumn("version", old).select(*columns), ["sop_uid"])
    new = objects.where("late = 5").withColumn("sop_uid", F.concat("sop_uid", F.lit(".late"))).select(*columns)
    rounds = C.make_consistent(left, right, meanwhile=lambda n: (new if n == 1 else None, None))
    return rounds.select("round", "n_studies", "to_left", "to_right")
