"""Extension points: named queries, validation rules, extractor sets."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators.filters import qido_filter
from scanloom.sources.sinks import read_study

QueryPlugin = Callable[[DataFrame, Mapping[str, object]], DataFrame]

_PLUGINS: dict[str, QueryPlugin] = {"studies_by_index": qido_filter}


def register_query(name: str, plugin: QueryPlugin) -> None:
    """Make ``plugin(table, parameters)`` available by name; a later one replaces it."""
    _PLUGINS[name] = plugin


def run_query(name: str, df: DataFrame, params: Mapping[str, object]) -> DataFrame:
    if name not in _PLUGINS:
        raise KeyError(f"no query plugin named {name}")
    return df.transform(lambda d: _PLUGINS[name](d, params))


def read_series_index(spark: SparkSession, path: str, study_uid: str, buckets: int | None = None) -> DataFrame:
    """Series rows of one study from a stored series table.

    For a table written in study buckets the bucket predicate prunes folders; the UID
    prunes row groups.
    """
    series = spark.read.parquet(path)
    if buckets:
        return read_study(series, study_uid, buckets).drop("study_bucket")
    return series.where(F.col("study_uid") == study_uid)


def validate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``errors``: names of the rules a row breaks. A rule that is NULL counts as broken."""
    checks = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("errors", F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid rows, rejected rows with errors)``."""
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)
