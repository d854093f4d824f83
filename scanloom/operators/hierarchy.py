"""Roll-up of instances into series, studies and the archive index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.joins import spread_join
from scanloom.operators.ordering import number_last_key, sort_studies, with_ordinal

STUDY = ["study_uid"]
SERIES = ["study_uid", "series_uid"]


def instance_key() -> Column:
    return number_last_key(F.col("instance_number"), F.col("sop_uid"))


def series_key() -> Column:
    return number_last_key(F.col("series_number"), F.col("series_uid"))


def series_summary(instances: DataFrame, attributes: list[str]) -> DataFrame:
    """Per series: attributes of its first instance and the number of instances.

    Aggregates only; the ordered instance list is the separate :func:`series_instances`,
    so that a series with very many instances never becomes one array.
    """
    first = F.min_by(F.struct(*attributes), instance_key())
    return (
        instances.groupBy(*SERIES)
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n_instances"))
        .select(*SERIES, "first.*", "n_instances")
    )


def series_instances(instances: DataFrame, attributes: list[str]) -> DataFrame:
    """Instance rows of every series in display order with their 1-based position."""
    rows = instances.select(
        *SERIES, "sop_uid", "instance_number", *[a for a in attributes if a not in ("sop_uid", "instance_number")]
    ).withColumn("_key", instance_key())
    return with_ordinal(rows, SERIES, [F.col("_key")], "position").drop("_key")


def study_summary(series: DataFrame, attributes: list[str] = ()) -> DataFrame:
    """Per study: series and instance counts, modalities in first-seen order, attributes.

    Series are reduced per (study, modality) first; a study then contributes one row
    per modality, however many series it has.
    """
    per_modality = series.groupBy("study_uid", "modality").agg(
        F.count(F.lit(1)).alias("n_series"),
        F.sum("n_instances").alias("n_instances"),
        F.min(series_key()).alias("seen"),
        *([F.min_by(F.struct(*attributes), series_key()).alias("attrs")] if attributes else []),
    )
    named = F.col("modality").isNotNull() & (F.col("modality") != "")
    seen = F.array_sort(F.collect_list(F.when(named, F.struct("seen", "modality"))))
    out = per_modality.groupBy("study_uid").agg(
        F.sum("n_series").alias("n_series"),
        F.sum("n_instances").alias("n_instances"),
        F.transform(seen, lambda x: x["modality"]).alias("modalities"),
        *([F.min_by("attrs", "seen").alias("attrs")] if attributes else []),
    )
    columns = ["study_uid", "n_series", "n_instances", "modalities"]
    return out.select(*columns, "attrs.*") if attributes else out.select(*columns)


def studies_index(instances: DataFrame, study_attributes: DataFrame, series_attributes: list[str]) -> DataFrame:
    """All study rows of the archive, in study order; a study without an attribute row has NULL attributes."""
    series = series_summary(instances, series_attributes)
    return sort_studies(study_summary(series).join(study_attributes, "study_uid", "left"))


def first_instance(instances: DataFrame, attributes: list[str]) -> DataFrame:
    """Attributes of the first instance of each study (lowest series, then instance)."""
    order = F.struct(series_key().alias("s"), instance_key().alias("i"))
    return (
        instances.groupBy("study_uid")
        .agg(F.min_by(F.struct(*attributes), order).alias("first"))
        .select("study_uid", "first.*")
    )


def tree_rollup(trees: DataFrame, order: str | None = None) -> DataFrame:
    """Roll nested Study.Series.Instances documents up to study rows.

    ``trees`` has ``study_uid`` and ``series``, a map of series id to
    ``struct<modality, instances: map<id, struct<n_frames>>>``; a large study may be
    split over several documents. Every document counts, and instances are counted
    both as objects and as frames. ``order`` names the column that puts the documents of a study in order, in which
    modalities are listed as they are first seen; without it the place inside a document decides, then the name.
    """
    series = trees.select("study_uid", *([F.col(order).alias("_doc")] if order else []), F.posexplode(F.map_entries("series")).alias("_at", "s"))
    series = series.withColumn("ord", F.struct("_doc", "_at") if order else F.struct("_at"))
    frames = F.aggregate(
        F.map_values("s.value.instances"),
        F.lit(0).cast("bigint"),
        lambda acc, i: acc + F.coalesce(F.nullif(i["n_frames"], F.lit(0)), F.lit(1)).cast("bigint"),
    )
    per_series = series.groupBy("study_uid", "s.key").agg(
        F.min(F.struct("ord", F.col("s.value.modality").alias("modality"))).alias("head"),
        F.sum(F.size("s.value.instances").cast("bigint")).alias("n_instances"),
        F.sum(frames).alias("n_frames"),
    )
    per_modality = per_series.groupBy("study_uid", F.col("head.modality").alias("modality")).agg(
        F.count(F.lit(1)).alias("n_series"),
        F.sum("n_instances").alias("n_instances"),
        F.sum("n_frames").alias("n_frames"),
        F.min("head.ord").alias("seen"),
    )
    seen = F.array_sort(F.collect_list(F.struct("seen", "modality")))
    return per_modality.groupBy("study_uid").agg(
        F.sum("n_series").alias("n_series"),
        F.sum("n_instances").alias("n_instances"),
        F.sum("n_frames").alias("n_frames"),
        F.transform(seen, lambda x: x["modality"]).alias("modalities"),
    )


def distinct_series(batch: DataFrame, attributes: list[str], order: Column) -> DataFrame:
    """One row per (study, series) of a batch, with the attributes that came first."""
    return (
        batch.groupBy(*SERIES)
        .agg(F.min_by(F.struct(*attributes), order).alias("first"))
        .select(*SERIES, "first.*")
    )


def affected_keys(batch: DataFrame, keys: list[str]) -> DataFrame:
    return batch.select(*keys).distinct()


def invalidate_summaries(summaries: DataFrame, batch: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Stored summaries that a batch of instances makes stale."""
    return summaries.join(affected_keys(batch, keys), keys, "left_semi")


def rebuild_affected(instances: DataFrame, batch: DataFrame, attributes: list[str]) -> DataFrame:
    """Series summaries recomputed for the series a batch touches, and no others."""
    touched = spread_join(instances, affected_keys(batch, SERIES), SERIES, ["sop_uid"], "left_semi")
    return series_summary(touched, attributes)


def build_missing(instances: DataFrame, existing: DataFrame, attributes: list[str]) -> DataFrame:
    """Series summaries for series that have none yet."""
    lacking = spread_join(instances, affected_keys(existing, SERIES), SERIES, ["sop_uid"], "left_anti")
    return series_summary(lacking, attributes)


def set_consistency(stored: DataFrame, actual: DataFrame, parent: list[str], uid: str) -> DataFrame:
    """Per parent: is the stored UID set the actual one, and how many are missing or extra."""
    keys = [*parent, uid]
    s = stored.select(*keys).distinct().withColumn("_stored", F.lit(True))
    a = actual.select(*keys).distinct().withColumn("_actual", F.lit(True))
    both = s.join(a, keys, "full_outer")
    missing, extra = F.col("_stored").isNull(), F.col("_actual").isNull()
    return both.groupBy(*parent).agg(
        F.count_if(missing).alias("n_missing"),
        F.count_if(extra).alias("n_extra"),
        F.bool_and(~missing & ~extra).alias("consistent"),
    )


def set_differences(stored: DataFrame, actual: DataFrame, parent: list[str], uid: str) -> DataFrame:
    """The single UIDs behind an inconsistent parent, one row each."""
    keys = [*parent, uid]
    s = stored.select(*keys).distinct().withColumn("_stored", F.lit(True))
    a = actual.select(*keys).distinct().withColumn("_actual", F.lit(True))
    both = s.join(a, keys, "full_outer").where("_stored IS NULL OR _actual IS NULL")
    return both.select(*keys, F.when(F.col("_stored").isNull(), "missing").otherwise("extra").alias("side"))


def navigate(
    studies: DataFrame, series: DataFrame, instances: DataFrame, study_columns: list[str], series_columns: list[str]
) -> DataFrame:
    """Instances with the columns of their study and series rows."""
    return (
        instances.join(series.select(*SERIES, *series_columns), SERIES)
        .join(studies.select("study_uid", *study_columns), "study_uid")
    )
