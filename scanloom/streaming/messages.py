"""Messages and notifications: collapsing, dispatch with retry, rolling status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.operators.ordering import first_per_key, latest_per_key
from scanloom.streaming.tables import read_batches, write_batch

MESSAGE = "type string, id string, data string, message_id string, sent_at timestamp"


def collapse_pending(messages: DataFrame, policy: str = "latest") -> DataFrame:
    """One message per (type, id): the latest, or the earliest, of those waiting."""
    order = [F.col("sent_at"), F.col("message_id")]
    pick = latest_per_key if policy == "latest" else first_per_key
    return pick(messages, ["type", "id"], order)


class MessageQueue:
    """At-least-once handling of messages with a bounded number of attempts.

    A micro-batch joins its new messages with the failures of the step before, collapses them per key and hands them to
    the ``succeeds`` rule; failures wait in a table for the next step, those out of attempts go to the dead letters.
    Steps are numbered across stream batches and drain rounds by a small log, so neither overwrites the other, and a
    batch that is run again finds its number and overwrites itself.
    """

    def __init__(
        self, root: str, succeeds: Callable[[DataFrame], Column], attempts: int = 3, policy: str | None = None
    ):
        self.root = root.rstrip("/")
        self.succeeds = succeeds
        self.attempts = attempts
        self.policy = policy

    @property
    def schema(self) -> str:
        return MESSAGE + ", attempt int"

    def _read(self, spark: SparkSession, table: str) -> DataFrame:
        return read_batches(spark, self.root, table, self.schema)

    def _step(self, spark: SparkSession, kind: str, number: int) -> int:
        """The step of a stream batch or drain round, a new one if it has none yet."""
        log = read_batches(spark, self.root, "steps", "kind string, number bigint")
        mine = (F.col("kind") == kind) & (F.col("number") == number)
        found, last = log.agg(F.max(F.when(mine, F.col("batch"))), F.max("batch")).first()
        if found is None:
            found = 0 if last is None else last + 1
            write_batch(spark.createDataFrame([(kind, number)], "kind string, number bigint"), self.root, "steps", found)
        return found

    def process(self, batch: DataFrame, batch_id: int, kind: str = "stream") -> None:
        spark = batch.sparkSession
        batch_id = self._step(spark, kind, batch_id)
        names = [f.name for f in T._parse_datatype_string(MESSAGE).fields]
        fresh = batch.select(*names).withColumn("attempt", F.lit(1))
        again = self._read(spark, "waiting").where(F.col("batch") == batch_id - 1).drop("batch")
        pending = fresh.unionByName(again.withColumn("attempt", F.col("attempt") + 1))
        if self.policy:
            pending = collapse_pending(pending, self.policy)
        marked = pending.withColumn("_ok", F.coalesce(self.succeeds(pending), F.lit(False)))
        write_batch(marked, self.root, "handled", batch_id)
        stored = spark.read.parquet(f"{self.root}/handled/batch={batch_id}")
        failed = stored.where("NOT _ok").drop("_ok")
        write_batch(stored.where("_ok").drop("_ok"), self.root, "done", batch_id)
        write_batch(failed.where(F.col("attempt") < self.attempts), self.root, "waiting", batch_id)
        write_batch(failed.where(F.col("attempt") >= self.attempts), self.root, "dead", batch_id)

    def run(self, stream: DataFrame) -> None:
        query = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.root}/_progress")
        query.trigger(availableNow=True).start().awaitTermination()

    def drain(self, spark: SparkSession) -> None:
        """Retry what waits until it is done or out of attempts; at most ``attempts`` rounds."""
        empty = spark.createDataFrame([], MESSAGE)
        for _ in range(self.attempts):
            steps = read_batches(spark, self.root, "steps", "kind string, number bigint")
            last, rounds = steps.agg(F.max("batch"), F.count_if(F.col("kind") == "drain")).first()
            if last is None or self._read(spark, "waiting").where(F.col("batch") == last).isEmpty():
                return
            self.process(empty, rounds, "drain")

    def done(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "done").drop("batch")

    def waiting(self, spark: SparkSession) -> DataFrame:
        """Messages that the next step will try, one per (type, id) when the queue collapses."""
        last = read_batches(spark, self.root, "steps", "kind string, number bigint").agg(F.max("batch")).first()[0]
        return self._read(spark, "waiting").where(F.col("batch") == F.lit(last)).drop("batch")

    def dead(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "dead").drop("batch")


def rolling_status(stream: DataFrame) -> DataFrame:
    """Running counts per job type; works on a stream (update or complete mode) and on a table.

    ``stream(type, event, failed)``: starts, ends and failed ends.
    """
    ended = F.col("event") == "end"
    return stream.groupBy("type").agg(
        F.count_if(F.col("event") == "start").alias("started"),
        F.count_if(ended).alias("completed"),
        F.count_if(ended & F.coalesce(F.col("failed"), F.lit(False))).alias("failed"),
    )


def run_rolling_status(stream: DataFrame, root: str) -> None:
    """Keep the newest status per type in ``<root>/status``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, root, "status", batch_id)

    query = rolling_status(stream).writeStream.outputMode("update").foreachBatch(save)
    query.option("checkpointLocation", f"{root}/_progress").trigger(availableNow=True).start().awaitTermination()


def read_rolling_status(spark: SparkSession, root: str) -> DataFrame:
    rows = read_batches(spark, root, "status", "type string, started bigint, completed bigint, failed bigint")
    return latest_per_key(rows, ["type"], [F.col("batch")]).drop("batch")
