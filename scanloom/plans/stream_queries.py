"""Queries of the streaming operators; each writes its tables to the shared working folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.plans import view as V
from scanloom.plans.registry import query, table
from scanloom.session import new_folder
from scanloom.streaming import ingest as S
from scanloom.streaming import messages as M
from scanloom.streaming import rates as T


def k():
    return F.get_json_object("props", "$.k").cast("bigint")


def event_arrivals(spark, folder):
    """Events as arriving objects: user = study, event type = series, (user, k) = object."""
    user = V.text("user_id")
    return table(spark, folder, "events").select(
        F.concat(F.lit("1.2."), user).alias("study_uid"),
        F.concat(F.lit("1.2."), user, F.lit("."), F.col("event_type")).alias("series_uid"),
        F.concat_ws(".", F.lit("1.2"), user, k().cast("string")).alias("sop_uid"),
        F.lit(None).cast("bigint").alias("series_number"),
        k().alias("instance_number"),
        F.col("event_type").alias("modality"),
        F.lit(1).alias("n_frames"),
        F.col("ts").cast("timestamp").alias("version"),
    )


def as_files(df, files, *order):
    """Write ``df`` as a few files for a file stream."""
    path = new_folder(df.sparkSession, "input")
    df.repartitionByRange(files, *order).write.parquet(path)
    return path


def run_archive(spark, folder, keep, order):
    rows = event_arrivals(spark, folder)
    path = as_files(rows, 3, *order)
    archive = S.ArchiveStream(new_folder(spark, "archive"), keep=keep, buckets=4)
    archive.run(S.file_stream(spark, path, rows.schema, files_per_batch=1))
    return archive


def sql_archive(direction):
    return f"""
WITH a AS (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts FROM events),
cur AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id, k
          ORDER BY ts {direction}, event_type {direction}) = 1),
s AS (SELECT user_id, event_type, count(*) AS n, arg_min(event_type, k) AS modality FROM cur GROUP BY user_id, event_type)
SELECT '1.2.' || user_id AS study_uid, count(*) AS n_series, sum(n)::BIGINT AS n_instances,
       string_agg(modality, ',' ORDER BY event_type) AS modalities FROM s GROUP BY user_id"""


def flat(df):
    return df.withColumn("modalities", F.array_join("modalities", ","))


@query("stream_ingest", sql_archive("ASC"))
def stream_ingest(spark, folder):
    """First arrival of an object wins, over several micro-batches."""
    return flat(run_archive(spark, folder, "first", ["version"]).studies(spark))


@query("late_arrivals", sql_archive("DESC"))
def late_arrivals(spark, folder):
    """Arrivals in an order unrelated to their versions: the newest version still wins."""
    return flat(run_archive(spark, folder, "newest", [F.xxhash64("sop_uid", "version")]).studies(spark))


@query("stream_series", """
WITH a AS (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts FROM events),
cur AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_type DESC) = 1)
SELECT '1.2.' || user_id AS study_uid, '1.2.' || user_id || '.' || event_type AS series_uid,
       CAST(NULL AS BIGINT) AS series_number, event_type AS modality, count(*) AS n_instances
FROM cur GROUP BY user_id, event_type""")
def stream_series(spark, folder):
    return run_archive(spark, folder, "newest", ["version"]).series(spark)


def messages(spark, folder):
    return table(spark, folder, "events").select(
        F.col("event_type").alias("type"),
        V.text("user_id").alias("id"),
        F.col("props").alias("data"),
        F.concat(F.lit("m"), F.lpad(V.text("event_id"), 12, "0")).alias("message_id"),
        F.col("ts").cast("timestamp").alias("sent_at"),
    )


@query("collapse_pending", """
SELECT event_type AS type, CAST(user_id AS VARCHAR) AS id, props AS data, 'm' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS message_id
FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1""")
def collapse_pending(spark, folder):
    return M.collapse_pending(messages(spark, folder)).drop("sent_at")


@query("collapse_pending_earliest", """
SELECT event_type AS type, CAST(user_id AS VARCHAR) AS id, props AS data, 'm' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS message_id
FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1""")
def collapse_pending_earliest(spark, folder):
    return M.collapse_pending(messages(spark, folder), "earliest").drop("sent_at")


@query("collapse_stream", """
SELECT event_type AS type, CAST(user_id AS VARCHAR) AS id, props AS data, 'm' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS message_id
FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1""")
def collapse_stream(spark, folder):
    """Messages that come in several micro-batches, none in order, while none can be handled: one per key waits."""
    rows = messages(spark, folder)
    path = as_files(rows, 3, F.xxhash64("message_id"))
    queue = M.MessageQueue(new_folder(spark, "queue"), lambda pending: F.lit(False), attempts=1_000_000, policy="latest")
    queue.run(S.file_stream(spark, path, rows.schema, files_per_batch=1))
    return queue.waiting(spark).drop("sent_at", "attempt")


@query("notification_source", """
SELECT event_type AS type, count(*) AS n, count(DISTINCT user_id) AS n_ids FROM events GROUP BY event_type""")
def notification_source(spark, folder):
    """Notification files written as JSON, picked up once each by a file stream."""
    rows = messages(spark, folder)
    source = new_folder(spark, "notify")
    rows.repartition(3).write.json(source)
    root = new_folder(spark, "claimed")
    stream = S.file_stream(spark, source, M.MESSAGE, fmt="json", files_per_batch=1, glob="*.json")
    sink = stream.writeStream.format("parquet").option("path", f"{root}/rows")
    sink.option("checkpointLocation", f"{root}/_progress").trigger(availableNow=True).start().awaitTermination()
    claimed = spark.read.schema(M.MESSAGE).parquet(f"{root}/rows")
    return claimed.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids")
    )


@query("dedupe_stream", """
SELECT DISTINCT '1.2.' || user_id || '.' || CAST(json_extract(props, '$.k') AS BIGINT) AS sop_uid, sha256(event_type) AS hash
FROM events""")
def dedupe_stream(spark, folder):
    rows = event_arrivals(spark, folder).select("sop_uid", F.sha2("modality", 256).alias("hash"), "version")
    path = as_files(rows, 3, F.xxhash64("sop_uid", "version"))
    stream = S.file_stream(spark, path, rows.schema, files_per_batch=1)
    seen = S.SeenTable(new_folder(spark, "seen"), ["sop_uid", "hash"], "sop_uid string, hash string", buckets=4)
    seen.run(S.drop_seen(stream, ["sop_uid", "hash"], "1 hour"))
    return seen.read(spark)


@query("settled_studies", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
           FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at, count(*) AS n_events FROM s GROUP BY user_id, session""")
def settled_studies(spark, folder):
    events = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = S.settled_sessions(events, "user_id", "ts", 6 * 3600)
    return out.select("user_id", F.unix_micros("first_at").alias("first_at"), F.unix_micros("last_at").alias("last_at"), "n_events")


@query("settled_stream", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
           FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at, count(*) AS n_events FROM s GROUP BY user_id, session""")
def settled_stream(spark, folder):
    """Events in order of time, a day and a third a batch or so; a period is given out once its quiet time has passed."""
    rows = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    path = S.in_order(rows, "ts", 5, new_folder(spark, "input"))
    # What comes long after the last event closes all periods, and is not closed itself.
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(F.lit(-1).cast("bigint").alias("user_id"), "ts")
    end.coalesce(1).write.mode("append").parquet(path)
    out = new_folder(spark, "settled")
    S.run_settled(S.file_stream(spark, path, rows.schema, files_per_batch=1), "user_id", "ts", "6 hours", "1 minute", out)
    periods = spark.read.schema("user_id bigint, first_at timestamp, last_at timestamp, n_events bigint").parquet(f"{out}/rows")
    return periods.select("user_id", F.unix_micros("first_at").alias("first_at"), F.unix_micros("last_at").alias("last_at"), "n_events")


@query("stream_rates", """
SELECT 3::BIGINT AS n_batches, count(*) AS n_rows, sum(strlen(props))::BIGINT AS n_bytes, true AS timed, count(*) AS n_copied FROM events""")
def stream_rates(spark, folder):
    """Events copied by a stream in three batches, with the rows and bytes that each moved."""
    rows = table(spark, folder, "events").select("event_id", "props")
    path, out = as_files(rows, 3, "event_id"), new_folder(spark, "copied")
    stream = S.file_stream(spark, path, rows.schema, files_per_batch=1)
    T.run_measured(stream, F.octet_length("props"), f"{out}/rows", f"{out}/_progress", f"{out}/rates")
    rates = T.read_rates(spark, f"{out}/rates").agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"),
        F.bool_and((F.col("rows_per_second") > 0) & (F.col("bytes_per_second") > 0) & (F.col("seconds") > 0)).alias("timed"),
    )
    copied = spark.read.schema(rows.schema).parquet(f"{out}/rows").agg(F.count(F.lit(1)).alias("n_copied"))
    return rates.join(copied)


@query("status_stream", """
SELECT CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) < 50 THEN 'store' ELSE 'index' END AS type,
  count(*) FILTER (event_type = 'signup') AS started, count(*) FILTER (event_type IN ('purchase', 'error')) AS completed,
  count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1""")
def status_stream(spark, folder):
    kind = F.col("event_type")
    rows = table(spark, folder, "events").select(
        F.when(k() < 50, "store").otherwise("index").alias("type"),
        F.when(kind == "signup", "start").when(kind.isin("purchase", "error"), "end").otherwise("update").alias("event"),
        (kind == "error").alias("failed"),
        F.col("event_id"),
    )
    path = as_files(rows, 3, "event_id")
    root = new_folder(spark, "status")
    M.run_rolling_status(S.file_stream(spark, path, rows.schema, files_per_batch=1), root)
    return M.read_rolling_status(spark, root)


@query("retry_failed", """
SELECT event_type AS type, 'm' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS message_id,
  CASE WHEN event_type <> 'error' THEN 1 WHEN value < 50 THEN 2 ELSE 3 END AS attempt,
  NOT (event_type = 'error' AND value >= 200) AS handled FROM events""")
def retry_failed(spark, folder):
    """Errors succeed at their second or third attempt, or never."""
    value = table(spark, folder, "events").select(V.text("value").alias("data"), *[
        c for c in ("event_type", "user_id", "event_id", "ts")
    ])
    rows = value.select(
        F.col("event_type").alias("type"), V.text("user_id").alias("id"), "data",
        F.concat(F.lit("m"), F.lpad(V.text("event_id"), 12, "0")).alias("message_id"),
        F.col("ts").cast("timestamp").alias("sent_at"),
    )

    def succeeds(pending):
        v = F.col("data").cast("double")
        return (
            (F.col("type") != "error")
            | ((v < 50) & (F.col("attempt") >= 2))
            | ((v < 200) & (F.col("attempt") >= 3))
        )

    # Runs, drains, and runs again on what has come meanwhile.
    path = as_files(rows.where(~(F.col("id").cast("bigint") % 5 == 0)), 2, "sent_at")
    queue = M.MessageQueue(new_folder(spark, "queue"), succeeds, attempts=3)
    queue.run(S.file_stream(spark, path, rows.schema, files_per_batch=1))
    queue.drain(spark)
    rows.where(F.col("id").cast("bigint") % 5 == 0).write.mode("append").parquet(path)
    queue.run(S.file_stream(spark, path, rows.schema, files_per_batch=1))
    queue.drain(spark)
    done, dead = queue.done(spark), queue.dead(spark)
    return done.withColumn("handled", F.lit(True)).unionByName(dead.withColumn("handled", F.lit(False))).select(
        "type", "message_id", "attempt", "handled"
    )
