"""Structured Streaming upkeep of the archive: arrivals in, series and study rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from scanloom.operators import hierarchy as H
from scanloom.operators.ordering import first_per_key, latest_per_key
from scanloom.session import release, settle
from scanloom.sources.documents import _existing
from scanloom.sources.sinks import study_bucket
from scanloom.streaming.tables import read_batches, write_batch

ARRIVAL = (
    "study_uid string, series_uid string, sop_uid string, series_number bigint, instance_number bigint, "
    "modality string, n_frames int, version timestamp"
)
STORED = ARRIVAL + ", arrived bigint"
SERIES_ROW = "study_uid string, series_uid string, series_number bigint, modality string, n_instances bigint"
STUDY_ROW = "study_uid string, n_series bigint, n_instances bigint, modalities array<string>"


class ArchiveStream:
    """Keeps an archive's objects and its series and studies index up to date.

    ``current`` has the one version of every object that counts, ``series`` and ``studies`` the index rows; each is a parquet
    table in folders by study bucket. A micro-batch reads the buckets it touches, merges its arrivals, and writes those
    buckets back by dynamic partition overwrite, from a result that was written down first. So the work of a batch follows
    the buckets it touches, not the number of batches before it, a batch that is run again changes nothing, and a stream
    that starts anew on a folder goes on with what is there. ``buckets`` should keep a bucket near the size of a few scan
    tasks.

    ``keep`` decides which version of an object counts: ``first`` ignores objects that are already stored, ``newest`` lets
    the newest version win, so late and out-of-order arrivals lead to the same tables as in-order ones.
    """

    def __init__(self, root: str, keep: str = "newest", buckets: int = 64, progress: str | None = None):
        self.root = root.rstrip("/")
        self.keep = keep
        self.buckets = buckets
        self.progress = progress or f"{self.root}/_progress"

    def process(self, batch: DataFrame, batch_id: int) -> None:
        columns = [f.name for f in T._parse_datatype_string(ARRIVAL).fields]
        rows = batch.select(*columns).withColumn("arrived", F.lit(batch_id).cast("bigint"))
        new = settle(self._placed(rows))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            old = self._read(batch.sparkSession, "current", STORED).where(F.col("bucket").isin(touched))
            merged = settle(self._current(old.unionByName(new)).repartitionByRange("bucket", "study_uid", "sop_uid"))
            series = settle(H.series_summary(merged, ["series_number", "modality"]))
            self._replace("current", merged)
            self._replace("series", self._placed(series))
            self._replace("studies", self._placed(H.study_summary(series)))
            release(merged, series)
        release(new)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", study_bucket(F.col("study_uid"), self.buckets))

    def _replace(self, table: str, rows: DataFrame) -> None:
        """The buckets of ``rows`` instead of those that are stored."""
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(f"{self.root}/{table}")

    def _read(self, spark: SparkSession, table: str, schema: str) -> DataFrame:
        path, full = f"{self.root}/{table}", schema + ", bucket int"
        if not _existing(spark, [path]):
            return spark.createDataFrame([], full)
        return spark.read.schema(full).parquet(path)

    def _current(self, rows: DataFrame) -> DataFrame:
        tie = [F.col(c) for c in ("series_uid", "instance_number", "modality", "n_frames", "arrived")]
        pick = latest_per_key if self.keep == "newest" else first_per_key
        return pick(rows, ["bucket", "study_uid", "sop_uid"], [F.col("version"), *tie])

    def instances(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "current", STORED).drop("arrived", "bucket")

    def series(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "series", SERIES_ROW).drop("bucket")

    def studies(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "studies", STUDY_ROW).drop("bucket")

    def compact(self, spark: SparkSession, root: str) -> ArchiveStream:
        """Copy the tables to a new folder, few files a bucket; the returned archive goes on with the progress of this one."""
        new = ArchiveStream(root, self.keep, self.buckets, self.progress)
        for table, schema in (("current", STORED), ("series", SERIES_ROW), ("studies", STUDY_ROW)):
            new._replace(table, self._read(spark, table, schema).repartitionByRange("bucket", "study_uid"))
        return new

    def start(self, arrivals: DataFrame, available_now: bool = True, interval: str = "1 minute") -> StreamingQuery:
        writer = arrivals.writeStream.foreachBatch(self.process).option("checkpointLocation", self.progress)
        trigger = {"availableNow": True} if available_now else {"processingTime": interval}
        return writer.trigger(**trigger).start()

    def run(self, arrivals: DataFrame) -> None:
        """Process everything that is there and stop."""
        self.start(arrivals).awaitTermination()


def file_stream(
    spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet", files_per_batch: int = 1000,
    glob: str | None = None,
) -> DataFrame:
    """Streaming read of new files; the number per batch is the back-pressure."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(path)


def drop_seen(stream: DataFrame, keys: list[str], horizon: str) -> DataFrame:
    """Drop repeats that arrive within the horizon.

    The watermark runs on the arrival time, not on a time in the data: state stays bounded
    and no row is ever too late, however old its own timestamps are.
    """
    arrived = stream.withColumn("_arrived", F.current_timestamp())
    return arrived.withWatermark("_arrived", horizon).dropDuplicatesWithinWatermark(keys).drop("_arrived")


class SeenTable:
    """Second stage of stream de-duplication: repeats older than the watermark, against a table.

    The table is laid out by key bucket; the history is first cut down to the keys of the
    batch, a join that prunes the bucket folders the batch does not touch. Keys are spread over all buckets, so a batch
    reads the keys of the whole history; ``horizon`` limits that to so many batches back, for sources that do not repeat
    what is older.
    """

    def __init__(self, root: str, keys: list[str], schema: str, buckets: int = 64, horizon: int | None = None):
        self.root, self.keys, self.schema, self.buckets, self.horizon = root, keys, schema, buckets, horizon

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        names = [f.name for f in T._parse_datatype_string(self.schema).fields]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        fresh = batch.select(*names).dropDuplicates(self.keys).withColumn("bucket", bucket)
        joint = ["bucket", *self.keys]
        stored = self._stored(spark, batch_id - 1)
        if self.horizon is not None:
            stored = stored.where(F.col("batch") >= batch_id - self.horizon)
        known = stored.select(*joint).join(fresh.select(*joint), joint, "left_semi")
        write_batch(fresh.join(known, joint, "left_anti"), self.root, "seen", batch_id, "bucket")

    def _stored(self, spark: SparkSession, last: int | None = None) -> DataFrame:
        return read_batches(spark, self.root, "seen", self.schema + ", bucket int", last)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).drop("batch", "bucket")

    def run(self, stream: DataFrame) -> None:
        query = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.root}/_progress")
        query.trigger(availableNow=True).start().awaitTermination()


def settled_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Periods of activity per key that end after ``gap_seconds`` of quiet.

    Events are first reduced to one row per key and gap-wide time bin (all events of a bin
    belong together), so a very busy key shrinks to a number of rows that only depends on
    the covered time.
    """
    gap = gap_seconds * 1_000_000
    at = F.unix_micros(ts)
    bins = (
        events.select(key, at.alias("_at"), F.floor(at / gap).alias("_bin"))
        .groupBy(key, "_bin")
        .agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    )
    w = Window.partitionBy(key).orderBy("_bin")
    fresh = F.coalesce((F.col("_lo") - F.lag("_hi").over(w) > gap).cast("int"), F.lit(1))
    numbered = bins.withColumn("_new", fresh).withColumn("_session", F.sum("_new").over(w))
    out = numbered.groupBy(key, "_session").agg(
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_n").alias("n_events")
    )
    return out.select(
        key, F.timestamp_micros("_lo").alias("first_at"), F.timestamp_micros("_hi").alias("last_at"), "n_events"
    )


def settled_stream(stream: DataFrame, key: str, ts: str, gap: str, lateness: str) -> DataFrame:
    """The same on a stream: a session is emitted once the watermark has passed its quiet time.

    Arrivals later than ``lateness`` no longer change an emitted session; they are still in
    the arrival log, from which :func:`settled_sessions` gives the full picture.
    """
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(F.session_window(ts, gap).alias("session"), key)
        .agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))
        .select(key, "first_at", "last_at", "n_events")
    )


def run_settled(stream: DataFrame, key: str, ts: str, gap: str, lateness: str, root: str) -> None:
    """Append the periods that :func:`settled_stream` closes to ``<root>/rows``.

    State holds the open periods only. With the arrival time as ``ts`` (:func:`arrival_time`) quiet is measured by the clock.
    """
    writer = settled_stream(stream, key, ts, gap, lateness).writeStream.outputMode("append").format("parquet")
    query = writer.option("path", f"{root}/rows").option("checkpointLocation", f"{root}/_progress").trigger(availableNow=True).start()
    query.awaitTermination()


def arrival_time(stream: DataFrame, name: str = "arrived_at") -> DataFrame:
    """The time at which a row's batch began, the clock by which quiet is measured whatever times the rows carry."""
    return stream.withColumn(name, F.current_timestamp())


def in_order(rows: DataFrame, ts: str, pieces: int, path: str) -> str:
    """Write a table as a stream's input: pieces of equal time, the earlier ones first."""
    lo, hi = rows.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    if lo is None:
        rows.write.parquet(path)
        return path
    step = (hi - lo) // pieces + 1
    for i in range(pieces):
        at = F.unix_micros(ts)
        piece = rows.where((at >= lo + i * step) & (at < lo + (i + 1) * step))
        piece.coalesce(1).write.mode("append").parquet(path)
    return path
