"""Transfer rates of running streams, kept as a table."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

TRANSFER = "transfer"
RATES = (
    "run string, name string, batch bigint, at string, seconds double, n_rows bigint, n_bytes bigint, "
    "rows_per_second double, bytes_per_second double"
)


def measured(stream: DataFrame, n_bytes: Column) -> DataFrame:
    """The stream with its rows and bytes counted on the way, batch by batch."""
    return stream.observe(TRANSFER, F.count(F.lit(1)).alias("n_rows"), F.sum(n_bytes).cast("bigint").alias("n_bytes"))


class RateListener(StreamingQueryListener):
    """Notes one row for every micro-batch of a measured stream; batches without rows are left out.

    Rows are held until :meth:`flush` appends them to the table, at the latest when a query ends; a row is a few numbers,
    so what is held grows with the number of batches since then only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._rows: list[tuple] = []
        self._lock, self._ended = threading.Lock(), threading.Condition()
        self._over: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(TRANSFER)
        if seen is None or not seen["n_rows"]:
            return
        seconds = max(p.batchDuration, 1) / 1000
        rows, size = seen["n_rows"], seen["n_bytes"] or 0
        with self._lock:
            self._rows.append((str(p.runId), p.name, p.batchId, p.timestamp, seconds, rows, size, rows / seconds, size / seconds))

    def onQueryTerminated(self, event) -> None:
        with self._ended:
            self._over.add(str(event.runId))
            self._ended.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 30) -> bool:
        """Until the listener has seen the query's end, so that all its batches are noted."""
        with self._ended:
            return self._ended.wait_for(lambda: str(query.runId) in self._over, seconds)

    def flush(self) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, RATES).coalesce(1).write.mode("append").parquet(self.path)


def run_measured(stream: DataFrame, n_bytes: Column, sink: str, checkpoint: str, rates: str) -> None:
    """Copy a stream to parquet files and its rates to the table ``rates``."""
    spark = stream.sparkSession
    listener = RateListener(spark, rates)
    spark.streams.addListener(listener)
    try:
        writer = measured(stream, n_bytes).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        listener.wait(query)
        listener.flush()
    finally:
        spark.streams.removeListener(listener)


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RATES).parquet(path)
