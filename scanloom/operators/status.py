"""Job status, progress and counters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.joins import spread_join

# Counter scopes and the scope each one adds to.
SCOPE_PARENTS: dict[str, str | None] = {
    "BufferStats": "StudyStats",
    "StudyStats": "OverallStats",
    "OverallStats": None,
}


def failed_end(failed: str = "failed", aborted: str = "aborted", failed_count: str = "failed_count") -> Column:
    no = F.lit(False)
    return F.coalesce(F.col(failed), no) | F.coalesce(F.col(aborted), no) | F.coalesce(F.col(failed_count) > 0, no)


def job_states(events: DataFrame) -> DataFrame:
    """One row per started job: start, last progress, end and failure.

    ``events(job_id, type, event, ts, failed, aborted, failed_count)``. The first end after
    the start counts; an end without a start is ignored, as are updates after the end.
    """
    keys = ["job_id", "type"]
    starts = events.where("event = 'start'").groupBy(*keys).agg(F.min("ts").alias("started"))
    later = spread_join(events.where("event <> 'start'"), starts, keys, ["ts"]).where(F.col("ts") >= F.col("started"))
    is_end = F.col("event") == "end"
    ends = later.where(is_end).groupBy(*keys).agg(
        F.min("ts").alias("ended"), F.min_by(failed_end(), F.struct("ts", failed_end())).alias("failed")
    )
    progress = later.where(~is_end).groupBy(*keys).agg(F.max("ts").alias("progressed"))
    return starts.join(ends, keys, "left").join(progress, keys, "left")


def job_status(states: DataFrame) -> DataFrame:
    """Per type: running, completed, failed (a subset of completed)."""
    done = F.col("ended").isNotNull()
    return states.groupBy("type").agg(
        F.count_if(~done).alias("running"),
        F.count_if(done).alias("completed"),
        F.count_if(done & F.col("failed")).alias("failed"),
    )


def _seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def job_progress(states: DataFrame, now: Column, kind: str | None = None) -> DataFrame:
    """Running jobs with seconds since start and since the last progress."""
    running = states.where(F.col("ended").isNull())
    if kind:
        running = running.where(F.col("type") == kind)
    return running.select(
        "job_id", "type",
        _seconds(F.col("started"), now).alias("seconds_since_started"),
        _seconds(F.col("progressed"), now).alias("seconds_since_progress"),
    )


def longest_waits(progress: DataFrame) -> DataFrame:
    """Largest waiting times over all running jobs."""
    return progress.agg(
        F.max(F.coalesce("seconds_since_started", F.lit(0.0))).alias("longest_since_started"),
        F.max(F.coalesce("seconds_since_progress", F.lit(0.0))).alias("longest_since_progress"),
    )


def stat_counters(events: DataFrame, parents: Mapping[str, str | None] = SCOPE_PARENTS) -> DataFrame:
    """Counters per scope and item, where a scope also counts what its children count.

    Events are counted first; only the counters are then repeated for each ancestor.
    """

    def chain(scope: str) -> list[str]:
        out = [scope]
        while parents.get(out[-1]):
            out.append(parents[out[-1]])
        return out

    ancestors = F.create_map(
        *[x for s in parents for x in (F.lit(s), F.array(*[F.lit(a) for a in chain(s)]))]
    )
    counted = events.groupBy("scope", "item").agg(F.count(F.lit(1)).alias("n"))
    lifted = counted.select(
        F.explode(F.coalesce(ancestors[F.col("scope")], F.array("scope"))).alias("scope"), "item", "n"
    )
    return lifted.groupBy("scope", "item").agg(F.sum("n").alias("n"))
