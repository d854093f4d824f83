"""Queries of synchronisation, responses, transfer statistics and job status."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import status as T
from scanloom.operators import sync as S
from scanloom.plans import view as V
from scanloom.plans.registry import query, table


def local_files(spark, folder):
    d = table(spark, folder, "documents")
    suffix = F.when(F.col("lang") == "en", ".json").otherwise(".mht")
    return d.select(
        F.concat(F.col("source"), F.lit("/"), V.text("doc_id"), suffix).alias("key"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.md5("text").alias("md5"),
        "doc_id", "source", "n_chars", "text",
    )


def remote_files(spark, folder):
    """The remote copy lacks src1, has other sizes in src2, other contents in src3, no ETag in src4."""
    rows = local_files(spark, folder).where("source <> 'src1'")
    src = F.col("source")
    etag = F.when(src == "src3", F.md5(F.concat("text", F.lit("x")))).when(src != "src4", F.col("md5"))
    return rows.select(
        "key", F.when(src == "src2", F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.concat(F.lit('"'), etag, F.lit('"')).alias("etag"),
    )


SQL_PLAN = """plan AS (SELECT source || '/' || doc_id || CASE lang WHEN 'en' THEN '.json' ELSE '.mht' END AS key,
  strlen(text)::BIGINT AS size, CASE WHEN source IN ('src1', 'src2') THEN 'transfer'
    WHEN source = 'src3' THEN 'transfer' ELSE 'exists' END AS action FROM documents)"""


@query("sync_plan", f"WITH {SQL_PLAN} SELECT key, size, action FROM plan")
def sync_plan(spark, folder):
    return S.sync_plan(local_files(spark, folder).select("key", "size", "md5"), remote_files(spark, folder)).drop("md5")


@query("sync_plan_compat", """SELECT source || '/' || doc_id || CASE lang WHEN 'en' THEN '.json' ELSE '.mht' END AS key,
  strlen(text)::BIGINT AS size, CASE WHEN source IN ('src1', 'src2') THEN 'transfer'
    WHEN source = 'src3' AND lang = 'en' AND strlen(text) <= 1048576 THEN 'transfer' ELSE 'exists' END AS action FROM documents""")
def sync_plan_compat(spark, folder):
    local = local_files(spark, folder).select("key", "size", "md5")
    return S.sync_plan(local, remote_files(spark, folder), compat=True).drop("md5")


@query("retrieve_plan", f"""WITH {SQL_PLAN}
SELECT key AS file_name, size + CASE WHEN starts_with(key, 'src2/') THEN 1 ELSE 0 END AS size,
  CASE WHEN action = 'transfer' THEN 'retrieve' ELSE 'skip' END AS action
FROM plan WHERE NOT starts_with(key, 'src1/') AND (contains(key, '.json') OR contains(key, '/1')) AND NOT contains(key, 'src19')""")
def retrieve_plan(spark, folder):
    remote = remote_files(spark, folder).withColumnRenamed("key", "file_name")
    local = local_files(spark, folder).select(F.col("key").alias("file_name"), "size", "md5")
    return S.retrieve_plan(remote, local, [".json", "/1"], ["src19"]).drop("etag")


@query("upload_result_counts", f"WITH {SQL_PLAN} SELECT action AS outcome, count(*) AS n FROM plan GROUP BY action")
def upload_result_counts(spark, folder):
    plan = S.sync_plan(local_files(spark, folder).select("key", "size", "md5"), remote_files(spark, folder))
    return S.outcome_counts(plan)


@query("upload_deletable", f"""WITH {SQL_PLAN}
SELECT 'dry' AS run, key FROM plan WHERE action = 'exists'
UNION ALL SELECT 'real', key FROM plan WHERE action = 'exists' OR key NOT LIKE 'src2/%'""")
def upload_deletable(spark, folder):
    """After a dry run only what the remote already had; after a real one, whose src2 uploads failed, the stored files too."""
    local = local_files(spark, folder).select("key", "size", "md5")
    dry = S.deletable(S.sync_plan(local, remote_files(spark, folder), dry_run=True))
    outcome = F.when(F.col("key").startswith("src2/"), "failed").otherwise("stored")
    plan = S.sync_plan(local, remote_files(spark, folder))
    real = S.deletable(plan.withColumn("action", F.when(F.col("action") == "transfer", outcome).otherwise(F.col("action"))))
    return dry.select(F.lit("dry").alias("run"), "key").unionByName(real.select(F.lit("real").alias("run"), "key"))


SQL_REQUESTS = """
req AS (SELECT user_id AS request_id, event_id AS position, event_type, 'f' || event_id || '.dcm' AS name,
               '1.2.' || event_id AS sop_uid, value FROM events)"""


@query("match_failures", f"""WITH {SQL_REQUESTS}
SELECT position, CASE WHEN value > 200 THEN NULL ELSE '/in/' || name END AS path,
  CASE WHEN value > 200 THEN 'none' WHEN value > 60 THEN 'location' WHEN value > 20 THEN 'uid' ELSE 'position' END AS match_kind,
  CASE WHEN value > 60 THEN '0xA700' ELSE '0xC000' END AS reason
FROM req WHERE event_type = 'error'""")
def match_failures(spark, folder):
    """Failed items that name their file, only their UID, or nothing; some have no file at all."""
    e = table(spark, folder, "events").withColumnRenamed("user_id", "request_id").withColumnRenamed("event_id", "position")
    name = F.concat(F.lit("f"), V.text("position"), F.lit(".dcm"))
    uid = F.concat(F.lit("1.2."), V.text("position"))
    v = F.col("value")
    files = e.where("event_type <> 'error' OR value <= 200").select(
        "request_id", "position", F.concat(F.lit("/in/"), name).alias("path"), uid.alias("sop_uid")
    )
    failed = e.where("event_type = 'error'").select(
        "request_id", "position",
        F.when(v > 60, name).when(v > 20, "other.dcm").alias("content_location"),
        F.when(v > 20, uid).alias("sop_uid"),
        F.when(v > 60, 42752).otherwise(49152).alias("failure_reason"),
    )
    return S.match_failures(failed, files).select("position", "path", "match_kind", "reason")


def store_items(spark, folder):
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.concat_ws("-", V.text("user_id"), F.floor(F.col("value") / 100).cast("string")).alias("request_id"),
        F.col("event_id").alias("position"),
        F.lit("1.2.840.10008.5.1.4.1.1.2").alias("sop_class_uid"),
        F.concat(F.lit("1.2."), V.text("event_id")).alias("sop_uid"),
        F.concat(F.lit("1.2.0."), V.text("user_id")).alias("study_uid"),
        (kind != "error").alias("ok"),
        F.when(kind == "purchase", 1).when(kind == "view", 0).alias("n_stream_errors"),
        F.when(F.col("value") > 10, 272).alias("failure_reason"),
    )


SQL_ITEMS = """
items AS (SELECT user_id || '-' || CAST(floor(value / 100) AS BIGINT) AS request_id, event_id AS position, user_id,
                 event_type NOT IN ('error', 'purchase') AS ok, value FROM events)"""


@query("store_response", f"""WITH {SQL_ITEMS}
SELECT request_id, count(*) FILTER (ok) AS n_stored, count(*) FILTER (NOT ok) AS n_failed,
  CASE WHEN count(*) FILTER (NOT ok) = 0 THEN 200 WHEN count(*) FILTER (ok) > 0 THEN 202 ELSE 409 END AS status,
  CASE WHEN count(*) FILTER (ok) > 0 THEN 'https://host/api/studies/1.2.0.' || min(user_id) END AS retrieve_url
FROM items GROUP BY request_id""")
def store_response(spark, folder):
    return S.store_response(store_items(spark, folder), "https://host/")


@query("store_response_items", f"""WITH {SQL_ITEMS}
SELECT request_id, position, '1.2.840.10008.5.1.4.1.1.2' AS sop_class_uid, '1.2.' || position AS sop_uid,
  CASE WHEN ok THEN 'referenced' ELSE 'failed' END AS sequence,
  CASE WHEN NOT ok THEN CASE WHEN value > 10 THEN 272 ELSE 49152 END END AS failure_reason,
  CASE WHEN NOT ok THEN 'item ' || position END AS error_comment FROM items""")
def store_response_items(spark, folder):
    items = store_items(spark, folder).withColumn("error", F.concat(F.lit("item "), V.text("position")))
    return S.store_response_items(items)


def clocked(spark, folder):
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("transfer_stats", """
SELECT event_type, count(*) AS n_files, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 2) AS seconds,
  round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS files_per_second
FROM events GROUP BY event_type""")
def transfer_stats(spark, folder):
    out = S.transfer_stats(clocked(spark, folder), ["event_type"])
    return out.select("event_type", "n_files", F.round("seconds", 2).alias("seconds"),
                      F.round("files_per_second", 6).alias("files_per_second"))


@query("transfer_progress", """
SELECT event_id, row_number() OVER w AS done, round(row_number() OVER w * 100 / count(*) OVER (PARTITION BY kind), 4) AS percent
FROM (SELECT event_id, ts, CASE WHEN event_type <> 'error' THEN event_type END AS kind FROM events) WINDOW w AS (PARTITION BY kind ORDER BY ts, event_id)""")
def transfer_progress(spark, folder):
    """Transfers without a name are one group."""
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    rows = clocked(spark, folder).select(kind.alias("kind"), "event_id", "ts")
    out = S.transfer_progress(rows, ["kind"], ["event_id"])
    return out.select("event_id", "done", F.round("percent", 4).alias("percent"))


@query("pack_groups", """
WITH RECURSIVE d AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
g AS (SELECT doc_id, source, n, n_chars AS fill, CAST(0 AS BIGINT) AS group_no FROM d WHERE n = 1
  UNION ALL SELECT d.doc_id, d.source, d.n, CASE WHEN g.fill + d.n_chars > 20000 THEN d.n_chars ELSE g.fill + d.n_chars END,
    CASE WHEN g.fill + d.n_chars > 20000 THEN g.group_no + 1 ELSE g.group_no END
  FROM g JOIN d ON d.source = g.source AND d.n = g.n + 1)
SELECT doc_id, source, group_no FROM g""")
def pack_groups(spark, folder):
    files = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return S.pack_groups(files, "source", ["doc_id"], "n_chars", limit=20000).select("doc_id", "source", "group_no")


def job_events(spark, folder):
    """A job per (user, k): views and clicks are progress, purchases and errors end it."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    return clocked(spark, folder).select(
        F.concat_ws("-", V.text("user_id"), k.cast("string")).alias("job_id"),
        F.when(k < 30, "store").when(k < 60, "index").otherwise("sync").alias("type"),
        F.when(kind == "signup", "start").when(kind.isin("view", "click"), "update").otherwise("end").alias("event"),
        "ts",
        (kind == "error").alias("failed"),
        F.lit(None).cast("boolean").alias("aborted"),
        F.when(F.col("value") > 100, 1).alias("failed_count"),
    )


SQL_JOBS = """
e AS (SELECT user_id || '-' || CAST(json_extract(props, '$.k') AS INTEGER) AS job_id,
  CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) < 30 THEN 'store'
       WHEN CAST(json_extract(props, '$.k') AS INTEGER) < 60 THEN 'index' ELSE 'sync' END AS type,
  CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type IN ('view', 'click') THEN 'update' ELSE 'end' END AS event,
  ts, event_type = 'error' OR value > 100 AS bad FROM events),
st AS (SELECT job_id, type, min(ts) AS started FROM e WHERE event = 'start' GROUP BY job_id, type),
jobs AS (SELECT st.job_id, st.type, started, min(e.ts) FILTER (event = 'end') AS ended,
    arg_min(bad, e.ts) FILTER (event = 'end') AS failed, max(e.ts) FILTER (event = 'update') AS progressed
  FROM st LEFT JOIN e ON e.job_id = st.job_id AND e.type = st.type AND e.ts >= started AND event <> 'start'
  GROUP BY st.job_id, st.type, started)"""


@query("job_status", f"""WITH {SQL_JOBS}
SELECT type, count(*) FILTER (ended IS NULL) AS running, count(*) FILTER (ended IS NOT NULL) AS completed,
       count(*) FILTER (ended IS NOT NULL AND failed) AS failed FROM jobs GROUP BY type""")
def job_status(spark, folder):
    return T.job_status(T.job_states(job_events(spark, folder)))


NOW = "2024-03-01 00:00:00"


@query("job_progress", f"""WITH {SQL_JOBS}
SELECT job_id, type, round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(started)) / 1e6, 3) AS seconds_since_started,
  round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(progressed)) / 1e6, 3) AS seconds_since_progress FROM jobs WHERE ended IS NULL""")
def job_progress(spark, folder):
    out = T.job_progress(T.job_states(job_events(spark, folder)), F.lit(NOW).cast("timestamp"))
    return out.select("job_id", "type", F.round("seconds_since_started", 3).alias("seconds_since_started"),
                      F.round("seconds_since_progress", 3).alias("seconds_since_progress"))


@query("job_longest_waits", f"""WITH {SQL_JOBS}
SELECT round(max((epoch_us(TIMESTAMP '{NOW}') - epoch_us(started)) / 1e6), 3) AS longest_since_started,
  round(max(coalesce((epoch_us(TIMESTAMP '{NOW}') - epoch_us(progressed)) / 1e6, 0)), 3) AS longest_since_progress
FROM jobs WHERE ended IS NULL""")
def job_longest_waits(spark, folder):
    progress = T.job_progress(T.job_states(job_events(spark, folder)), F.lit(NOW).cast("timestamp"))
    out = T.longest_waits(progress)
    return out.select(*[F.round(c, 3).alias(c) for c in out.columns])


@query("stat_counters", """
WITH s AS (SELECT CASE WHEN value < 20 THEN 'BufferStats' WHEN value < 60 THEN 'StudyStats' ELSE 'OverallStats' END AS scope,
  event_type AS item FROM events)
SELECT 'BufferStats' AS scope, item, count(*) AS n FROM s WHERE scope = 'BufferStats' GROUP BY item
UNION ALL SELECT 'StudyStats', item, count(*) FROM s WHERE scope <> 'OverallStats' GROUP BY item
UNION ALL SELECT 'OverallStats', item, count(*) FROM s GROUP BY item""")
def stat_counters(spark, folder):
    v = F.col("value")
    scope = F.when(v < 20, "BufferStats").when(v < 60, "StudyStats").otherwise("OverallStats")
    return T.stat_counters(table(spark, folder, "events").select(scope.alias("scope"), F.col("event_type").alias("item")))
