"""Index maintenance: upsert, purge, set operations, change detection, consistency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.ordering import latest_per_key


def index_upsert(base: DataFrame, updates: DataFrame, keys: list[str], version: list[str] = ()) -> DataFrame:
    """Updated rows replace those with the same key, new ones are added, the last update wins."""
    if version:
        updates = latest_per_key(updates, keys, [F.col(v) for v in version])
    columns = base.columns
    new = updates.select(*keys, F.struct(*columns).alias("_new"))
    old = base.select(*keys, F.struct(*columns).alias("_old"))
    return old.join(new, keys, "full_outer").select(F.coalesce("_new", "_old").alias("r")).select("r.*")


def index_purge(index: DataFrame, live: DataFrame, keys: list[str], touched: DataFrame | None = None) -> DataFrame:
    """Drop rows whose object no longer exists; rows touched by this update stay."""
    alive = live.select(*keys)
    if touched is not None:
        alive = alive.unionByName(touched.select(*keys))
    return index.join(alive.distinct(), keys, "left_semi")


def concat_indexes(*indexes: DataFrame) -> DataFrame:
    """Append index tables; columns one of them lacks are NULL."""
    out = indexes[0]
    for other in indexes[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def delete_studies(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Every given table without the rows of the deleted studies."""
    gone = deleted.select("study_uid").distinct()
    return {name: df.join(gone, "study_uid", "left_anti") for name, df in tables.items()}


def unique_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def select_uids(present: DataFrame, requested: DataFrame, keys: list[str]) -> DataFrame:
    """Present rows that were asked for."""
    return present.join(requested.select(*keys).distinct(), keys, "left_semi")


def row_hash(*columns: str) -> Column:
    """Hash of the values of a row; NULL and empty text differ."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def change_set(before: DataFrame, written: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome per output key of a write.

    ``before(keys, version)`` is what was seen when the write began, ``now(keys, version,
    content_hash)`` what is stored at its end, ``written(keys, content_hash)`` the new content:
    identical, created, updated, or updated-stale when someone else changed the target meanwhile.
    Stored keys that nothing was written to are ``untouched``.
    """
    b = before.select(*keys, F.col("version").alias("_seen"))
    n = now.select(*keys, F.col("version").alias("_version"), F.col("content_hash").alias("_stored"))
    w = written.select(*keys, F.col("content_hash").alias("_written"))
    rows = n.join(w, keys, "full_outer").join(b, keys, "left")
    exists = F.col("_version").isNotNull()
    moved = exists & ~F.col("_version").eqNullSafe(F.col("_seen"))
    status = (
        F.when(F.col("_written").isNull(), "untouched")
        .when(exists & (F.col("_written") == F.col("_stored")), "identical")
        .when(moved, "updated-stale")
        .when(F.col("_seen").isNull(), "created")
        .otherwise("updated")
    )
    return rows.select(*keys, status.alias("status"))


def next_free_names(wanted: DataFrame, existing: DataFrame, limit: int = 99) -> DataFrame:
    """First unused of ``name``, ``name-1`` ... ``name-<limit>``; NULL when all are taken.

    Existing names are read as (base, number), so a name costs one row instead of one
    candidate row per number.
    """
    plain = existing.select(F.col("name").alias("base"), F.lit(0).alias("n"))
    pattern = r"^(.*)-([1-9][0-9]*)$"
    numbered = existing.select(
        F.regexp_extract("name", pattern, 1).alias("base"),
        F.regexp_extract("name", pattern, 2).try_cast("int").alias("n"),
    ).where(F.col("n") <= limit)
    used = plain.unionByName(numbered).groupBy("base").agg(F.collect_set("n").alias("used"))
    rows = wanted.select("name").distinct().join(used, wanted["name"] == used["base"], "left")
    free = F.array_except(
        F.sequence(F.lit(0), F.lit(limit)), F.coalesce("used", F.array().cast("array<int>"))
    )
    first = F.get(free, F.lit(0))
    chosen = F.when(first == 0, F.col("name")).when(
        first.isNotNull(), F.concat("name", F.lit("-"), first.cast("string"))
    )
    return rows.select("name", chosen.alias("free_name"))


def replica_differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per key: same, changed, or only on one side."""
    a = left.select(*keys, row_hash(*columns).alias("_a"))
    b = right.select(*keys, row_hash(*columns).alias("_b"))
    status = (
        F.when(F.col("_a").isNull(), "missing")
        .when(F.col("_b").isNull(), "extra")
        .when(F.col("_a") == F.col("_b"), "identical")
        .otherwise("changed")
    )
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def consistency_round(
    replica: DataFrame, other: DataFrame, build_index: Callable[[DataFrame], DataFrame], keys: list[str],
    columns: list[str],
) -> DataFrame:
    """One round between two replicas of the arrivals: merge both, rebuild the index from the
    merged arrivals, and compare it with the index the replica has now."""
    merged = build_index(concat_indexes(replica, other))
    return replica_differences(merged, build_index(replica), keys, columns)


def consistent(differences: DataFrame) -> DataFrame:
    """One row: number of differing keys, and whether a round left nothing to upload."""
    differing = F.count_if(F.col("status") != "identical")
    return differences.agg(differing.alias("n_uploads"), (differing == 0).alias("consistent"))
