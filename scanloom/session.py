"""Session settings and the shared folder for materialised intermediates."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def archive_session(master: str | None = None, cpus: int | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName("scanloom")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Skewed partitions are split also where an aggregation on the same keys follows the join.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # A busy key's sessions merge before the shuffle.
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if cpus:
        settings["spark.sql.shuffle.partitions"] = str(cpus)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The cluster's shared working folder, ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, which goes when Python ends; a cluster
    session without it is an error, because executors share no local disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="scanloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the working folder."""
    return f"{work_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``compression`` is the files', Spark's default if None.

    Cuts lineage reliably: values that depend on the physical layout (such as the
    partition id) stay what they were when an executor is lost later.
    """
    spark = df.sparkSession
    path = new_folder(spark, "settled")
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def settle_bucketed(df: DataFrame, by: list[str], buckets: int, placed: bool = False) -> DataFrame:
    """Like :func:`settle`, as a table in buckets by ``by``: joins and groups by these columns move none of its rows.

    Rows that are ``placed`` lie by these columns in as many partitions already and are not moved before.
    """
    path = new_folder(df.sparkSession, "bucketed")
    name = "t_" + path.rpartition("/")[2].replace("-", "_")
    rows = df if placed else df.repartition(buckets, *by)
    rows.write.format("parquet").bucketBy(buckets, *by).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = df.sparkSession.table(name)
    out._settled, out._table = path, name
    return out


def release(*frames: DataFrame) -> None:
    """Remove the folders of settled frames that nothing reads any more; frames that were not settled are passed over.

    For intermediates of a job that are superseded: what was made from them must have been settled itself before.
    """
    for df in frames:
        path, df._settled = getattr(df, "_settled", None), None
        if path:
            spark = df.sparkSession
            if table := getattr(df, "_table", None):
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more.

    Spark does so when the driver's garbage is collected, which may be long after a large shuffle's last use.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that run meanwhile exchange at most so many rows at a time with Python; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most if int(before) <= 0 else min(most, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)
