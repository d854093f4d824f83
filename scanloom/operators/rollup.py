"""Series and study summaries kept up by adding what a batch changes, without reading the instances again.

A series' state is its number of instances and its first instance: key, UID and attributes. Inserts and most updates
merge into it; only where the first instance is deleted or moves back does a series' next one have to be looked up.

Tables that have the column of :func:`with_series_cell` and lie in buckets by it are joined and grouped inside their buckets.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.hierarchy import SERIES, instance_key, study_summary
from scanloom.operators.joins import split_hot_keys
from scanloom.operators.stored import CELL, joined_in_place
from scanloom.session import settle, settle_bucketed

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def _first(attributes: list[str]) -> Column:
    return F.struct(instance_key().alias("key"), F.col("sop_uid").alias("sop_uid"), F.struct(*attributes).alias("attrs"))


def with_series_cell(rows: DataFrame) -> DataFrame:
    """Rows with the cell of their series, by which they can be laid in buckets."""
    return rows.withColumn(CELL, F.xxhash64(*SERIES))


def _keys(*frames: DataFrame) -> list[str]:
    """The columns of a series, with its cell where all frames have it."""
    return [CELL, *SERIES] if all(CELL in df.columns for df in frames) else SERIES


def series_state(instances: DataFrame, attributes: list[str]) -> DataFrame:
    """``(study_uid, series_uid, n_instances, first)`` of every series, ``first`` its first instance; the cell too, if it is there."""
    return instances.groupBy(*_keys(instances)).agg(F.count(F.lit(1)).alias("n_instances"), F.min_by(_first(attributes), instance_key()).alias("first"))


def summaries(state: DataFrame) -> DataFrame:
    """The series summaries of a state, as a full build gives them."""
    return state.select(*SERIES, "first.attrs.*", "n_instances")


def _matched(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """``left`` as l, ``right`` as r, joined by series; NULL UIDs are one series, a cell is never NULL."""
    pairs = [(k, F.col(f"l.{k}"), F.col(f"r.{k}")) for k in _keys(left, right)]
    same = reduce(lambda a, b: a & b, [l == r if k == CELL else l.eqNullSafe(r) for k, l, r in pairs])
    return left.alias("l").join(right.alias("r"), same, how)


def merge_changes(state: DataFrame, changes: DataFrame, attributes: list[str]) -> DataFrame:
    """State after a batch, with ``stale`` where the first instance has to be looked up.

    ``changes(op, study_uid, series_uid, sop_uid, instance_number, attributes)`` has each object once: ``insert`` and
    ``update`` with its new values, ``delete`` with its UIDs. Series without instances are gone. Changes combine map-side
    into one row per series; an object in the batch is compared with one stored row, its series'.
    """
    keys = _keys(state, changes)
    firsts = state.select(*keys, F.col("first.sop_uid").alias("_sop"), F.col("first.key").alias("_key"))
    own = (F.col("_sop") == F.col("sop_uid")) & (F.col("op") != INSERT)
    later = (F.col("op") == DELETE) | (instance_key() > F.col("_key"))
    rows = _matched(changes, firsts, "left").select(
        *[F.col(f"l.{k}") for k in keys], "op", "instance_number", "sop_uid", *[F.col(f"l.{a}") for a in attributes],
        F.coalesce(own, F.lit(False)).alias("_own"), F.coalesce(own & later, F.lit(False)).alias("_lost"),
    )
    there = F.col("op") != DELETE
    delta = rows.groupBy(*keys).agg(
        (F.count_if(F.col("op") == INSERT) - F.count_if(F.col("op") == DELETE)).alias("_n"),
        F.min_by(F.when(there, _first(attributes)), F.when(there, instance_key())).alias("_new"),
        F.max("_own").alias("_own"), F.max("_lost").alias("_lost"),
    )
    met = _matched(state, delta, "full_outer")
    n = F.coalesce("n_instances", F.lit(0)) + F.coalesce("_n", F.lit(0))
    kept = F.when(~F.coalesce("_own", F.lit(False)), F.col("first"))
    first = F.when(kept.isNull(), F.col("_new")).when(F.col("_new").isNull(), kept).when(F.col("_new.key") < kept["key"], F.col("_new")).otherwise(kept)
    lost = F.coalesce("_lost", F.lit(False))
    out = met.select(
        *[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys], n.alias("n_instances"), F.when(~lost, first).alias("first"), lost.alias("stale")
    )
    return out.where("n_instances > 0")


def roll_up(state: DataFrame, changes: DataFrame, attributes: list[str], instances_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """State after a batch; ``instances_of(series)`` reads the instances, as they are afterwards, of the series given by their UIDs.

    It is called only if there are series to look up, and with those alone. Where state and changes lie in buckets by the
    cell of their series, so do the merged rows, and neither is moved.
    """
    keys, spark = _keys(state, changes), state.sparkSession
    with joined_in_place(spark):
        rows = merge_changes(state, changes, attributes)
        if CELL in keys:
            merged = settle_bucketed(rows, [CELL], int(spark.conf.get("spark.sql.shuffle.partitions")), placed=True)
        else:
            merged = settle(rows)
        stale = merged.where("stale").select(*keys)
        fresh = merged.where("NOT stale").drop("stale")
        if stale.isEmpty():
            return fresh
        again = settle(series_state(instances_of(stale), attributes), "zstd")
    return fresh.select(*[c for c in fresh.columns if c in again.columns]).unionByName(again)


def reader_of(instances: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Looks series up in one table, without their order or layout."""
    return lambda series: _matched(split_hot_keys(instances), series, "left_semi")


def bucket_reader(archive: DataFrame, bucket: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """Looks series up in an archive in study bucket folders: only their buckets are read.

    The driver gets the numbers of these buckets, at most as many as the archive has.
    """
    def read(series: DataFrame) -> DataFrame:
        numbers = [r[0] for r in series.select(bucket(F.col("study_uid"))).distinct().collect()]
        return _matched(split_hot_keys(archive.where(F.col("study_bucket").isin(numbers))), series, "left_semi")

    return read


def touched_studies(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Study rows of the studies in a batch, from the state of their series."""
    studies = changes.select(F.col("study_uid").alias("_study")).distinct()
    return study_summary(summaries(split_hot_keys(state).join(studies, F.col("study_uid").eqNullSafe(F.col("_study")), "left_semi")))
