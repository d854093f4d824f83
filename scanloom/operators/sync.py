"""Synchronisation plans, store responses, transfer statistics and upload groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions.paths import include_exclude, retrieve_url
from scanloom.operators.ordering import same_keys, sliced, with_ordinal_and_totals

MIB = 1024 * 1024
DEFAULT_FAILURE = 0xC000


def _same_object(size: str, other_size: str, name: str, etag: str, md5: str, compat: bool) -> Column:
    """Stored and local object are taken as equal: same size, and same MD5 where both sides have one.

    An ETag with a hyphen is that of an upload in parts and no MD5. With ``compat`` the MD5 counts only for names with
    ``json`` up to 1 MiB, as tools did that could not afford to read large files twice.
    """
    tag = F.coalesce(F.col(etag), F.lit(""))
    enough = (tag == "") | tag.contains("-") | F.col(md5).isNull() | (F.col(md5) == tag)
    if compat:
        enough = enough | (F.col(size) > MIB) | ~F.col(name).contains("json")
    return F.coalesce((F.col(size) == F.col(other_size)) & enough, F.lit(False))


def sync_plan(
    local: DataFrame, remote: DataFrame, dry_run: bool = False, force: bool = False, compat: bool = False
) -> DataFrame:
    """Action per local file: skip what the remote already has, transfer the rest.

    ``local(key, size, md5)``, ``remote(key, size, etag)``.
    """
    r = remote.select("key", F.col("size").alias("_size"), F.regexp_replace("etag", "['\"]", "").alias("_etag"))
    rows = local.join(r, "key", "left")
    skip = _same_object("size", "_size", "key", "_etag", "md5", compat) & F.lit(not force)
    action = F.when(skip, "exists").otherwise("dryrun" if dry_run else "transfer")
    return rows.select(*local.columns, action.alias("action"))


def retrieve_plan(
    remote: DataFrame, local: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ("temp",),
    force: bool = False, compat: bool = False,
) -> DataFrame:
    """The other direction: action per remote object in scope, ``skip`` or ``retrieve``.

    ``remote(file_name, size, etag)``, ``local(file_name, size, md5)``.
    """
    scope = remote.where(include_exclude(F.col("file_name"), include, exclude))
    mine = local.select("file_name", F.col("size").alias("_size"), F.col("md5").alias("_md5"))
    rows = scope.withColumn("_etag", F.regexp_replace("etag", "['\"]", "")).join(mine, "file_name", "left")
    skip = _same_object("_size", "size", "file_name", "_etag", "_md5", compat) & F.lit(not force)
    return rows.select(*remote.columns, F.when(skip, "skip").otherwise("retrieve").alias("action"))


def outcome_counts(plan: DataFrame, column: str = "action") -> DataFrame:
    return plan.groupBy(F.col(column).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def deletable(plan: DataFrame, successful: bool = True, failed: bool = False) -> DataFrame:
    """Keys whose local file may be deleted after the upload: those that are ``stored`` or already ``exists``.

    A file that was only planned or tried for show is on one side alone and stays; ``failed`` adds failed ones.
    """
    kinds = (["stored", "exists"] if successful else []) + (["failed"] if failed else [])
    return plan.where(F.col("action").isin(*kinds)).select("key")


def match_failures(failed: DataFrame, files: DataFrame) -> DataFrame:
    """Input file of each failed item: by content location, else object UID, else position.

    ``position`` counts the files of a request, and the failed items of its response. Several files with the same name or
    UID resolve to the earliest one.
    """
    first = F.min_by("path", "position")
    base = F.regexp_extract("path", "([^/]*)$", 1)
    by_name = files.groupBy("request_id", base.alias("content_location")).agg(first.alias("_by_name"))
    by_uid = files.where("sop_uid IS NOT NULL").groupBy("request_id", "sop_uid").agg(first.alias("_by_uid"))
    by_place = files.select("request_id", "position", F.col("path").alias("_by_place"))
    rows = (
        failed.join(by_name, ["request_id", "content_location"], "left")
        .join(by_uid, ["request_id", "sop_uid"], "left")
        .join(by_place, ["request_id", "position"], "left")
    )
    kind = (
        F.when(F.col("_by_name").isNotNull(), "location")
        .when(F.col("_by_uid").isNotNull(), "uid")
        .when(F.col("_by_place").isNotNull(), "position")
        .otherwise("none")
    )
    return rows.select(
        *failed.columns,
        F.coalesce("_by_name", "_by_uid", "_by_place").alias("path"),
        kind.alias("match_kind"),
        F.concat(F.lit("0x"), F.hex("failure_reason")).alias("reason"),
    )


def store_response_items(items: DataFrame, default_reason: int = DEFAULT_FAILURE) -> DataFrame:
    """Stored and failed items of each request, one row each; a failed one carries its ``error`` text if there is one."""
    said = F.col("error") if "error" in items.columns else F.lit(None).cast("string")
    ok = F.col("ok") & (F.coalesce(F.col("n_stream_errors"), F.lit(0)) == 0)
    return items.select(
        "request_id", "position", "sop_class_uid", "sop_uid",
        F.when(ok, "referenced").otherwise("failed").alias("sequence"),
        F.when(~ok, F.coalesce("failure_reason", F.lit(default_reason))).alias("failure_reason"),
        F.when(~ok, said).alias("error_comment"),
    )


def store_response(items: DataFrame, root_url: str = "") -> DataFrame:
    """Response head per request: counts, status 200 / 202 / 409, retrieve URL of the first success.

    The item sequences are rows of :func:`store_response_items`; a request of any size
    aggregates to one row without collecting them.
    """
    ok = F.col("ok") & (F.coalesce(F.col("n_stream_errors"), F.lit(0)) == 0)
    heads = items.groupBy("request_id").agg(
        F.count_if(ok).alias("n_stored"),
        F.count_if(~ok).alias("n_failed"),
        F.min_by(F.when(ok, F.col("study_uid")), F.when(ok, F.col("position"))).alias("_study"),
    )
    status = F.when(F.col("n_failed") == 0, 200).when(F.col("n_stored") > 0, 202).otherwise(409)
    return heads.select(
        "request_id", "n_stored", "n_failed", status.alias("status"),
        retrieve_url(F.col("_study"), F.lit(root_url)).alias("retrieve_url"),
    )


def _seconds(start, end):
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def transfer_stats(done: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Count, elapsed seconds and files per second of each transfer."""
    out = done.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_files"), F.min(ts).alias("_from"), F.max(ts).alias("_to")
    )
    elapsed = _seconds(F.col("_from"), F.col("_to"))
    return out.select(
        *keys, "n_files", elapsed.alias("seconds"),
        F.when(elapsed > 0, F.col("n_files") / elapsed).alias("files_per_second"),
    )


def transfer_progress(done: DataFrame, keys: list[str], order: list[str], ts: str = "ts") -> DataFrame:
    """Percent done, speed and estimated seconds left after each file."""
    numbered, totals = with_ordinal_and_totals(
        done, keys, [F.col(ts), *[F.col(o) for o in order]], "done",
        {"_total": F.count(F.lit(1)), "_from": F.min(ts)},
    )
    rows = numbered.alias("n").join(totals.alias("t"), same_keys("n", "t", keys))
    elapsed = _seconds(F.col("_from"), F.col(f"n.{ts}"))
    speed = F.when(elapsed > 0, F.col("done") / elapsed)
    return rows.select(
        *[F.col(f"n.{c}") for c in done.columns], "done",
        (F.col("done") * 100 / F.col("_total")).alias("percent"),
        speed.alias("files_per_second"),
        ((F.col("_total") - F.col("done")) / speed).alias("seconds_left"),
    )


def _group_ends(size: np.ndarray, limit: int) -> np.ndarray:
    """For a group that starts at each row: index of the row that opens the next group."""
    total = np.concatenate(([0], np.cumsum(size)))
    nxt = np.searchsorted(total, total[:-1] + limit, side="right") - 1
    return np.maximum(nxt, np.arange(len(size)) + 1)


def pack_groups(
    files: DataFrame, bucket: str, order: list[str], size: str, limit: int = 10 * MIB, slices: int | None = None
) -> DataFrame:
    """Consecutive upload groups of at most ``limit`` bytes, in file order; adds ``group_no``.

    A file opens a new group when it would exceed the limit of a non-empty one, so a file
    above the limit is alone. The result is that of one sequential pass per bucket, yet a
    bucket is not handled by one task: its rows are range-partitioned into slices, every
    slice works out what it does for each possible opening row (only the few rows that fit
    into the group left open by the slice before), and the slices are then chained.
    """
    keep = files.columns
    placed = sliced(files.withColumn("_size", F.col(size).cast("bigint")), [bucket], [F.col(o) for o in order], slices)
    bucket_type = files.schema[bucket].dataType.simpleString()

    def outline(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        sizes = pdf["_size"].to_numpy()
        n = len(sizes)
        total = np.concatenate(([0], np.cumsum(sizes)))
        nxt = _group_ends(sizes, limit)
        # A group left open by an earlier slice can take at most these leading rows.
        heads = int(np.searchsorted(total[1:], limit, side="right")) + 1
        opened = np.zeros(n, dtype=np.int64)
        last = np.zeros(n, dtype=np.int64)
        for i in range(n - 1, -1, -1):
            j = nxt[i]
            opened[i] = 1 + (opened[j] if j < n else 0)
            last[i] = last[j] if j < n else total[n] - total[i]
        m = min(heads, n)
        return pd.DataFrame({
            "_slice": [pdf["_slice"].iloc[0]], bucket: [pdf[bucket].iloc[0]], "total": [int(total[n])],
            "n": [n], "lead": [total[1:m + 1].tolist()], "opened": [opened[:m].tolist()], "fill": [last[:m].tolist()],
        })

    outlines = placed.select("_slice", bucket, *[o for o in order if o != bucket], "_size").groupBy(
        "_slice", bucket
    ).applyInPandas(
        outline,
        f"_slice int, {bucket} {bucket_type}, total bigint, n bigint, lead array<bigint>, "
        "opened array<bigint>, fill array<bigint>",
    )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out, number, fill, is_open = [], 0, 0, False
        columns = ["_slice", bucket, "total", "n", "lead", "opened", "fill"]
        for place, key, total, n, lead, opened, left in (
            pdf.sort_values("_slice")[columns].itertuples(index=False, name=None)
        ):
            out.append((place, key, number, fill, is_open))
            at = int(np.searchsorted(np.asarray(lead), limit - fill, side="right")) if is_open else 0
            if at >= n:
                fill += total
            else:
                number, fill, is_open = number + int(opened[at]), int(left[at]), True
        return pd.DataFrame(out, columns=["_slice", bucket, "number", "fill", "is_open"])

    # One row per slice and bucket: the chain is as long as the number of slices, not of files.
    starts = outlines.groupBy(bucket).applyInPandas(
        chain, f"_slice int, {bucket} {bucket_type}, number bigint, fill bigint, is_open boolean"
    )

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(order, kind="stable").reset_index(drop=True)
        start = right.iloc[0]
        sizes = left["_size"].to_numpy()
        nxt = _group_ends(sizes, limit)
        groups = np.zeros(len(sizes), dtype=np.int64)
        at, number = 0, int(start["number"])
        if start["is_open"]:
            at = int(np.searchsorted(np.cumsum(sizes), limit - int(start["fill"]), side="right"))
            groups[:at] = number - 1
        while at < len(sizes):
            groups[at:nxt[at]] = number
            at, number = nxt[at], number + 1
        left["group_no"] = groups
        return left[[*keep, "group_no"]]

    schema = placed.select(*keep).schema.add("group_no", T.LongType())
    return placed.groupBy("_slice", bucket).cogroup(starts.groupBy("_slice", bucket)).applyInPandas(assign, schema)
