"""Metadata de-duplication by content hash, recombination, and the de-duplication log."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.tags import canonical_lines, content_hash, lines_text, project, without
from scanloom.model import DATASET_TYPE, IMAGE_EXTRACT, PATIENT_QUERY, SERIES_EXTRACT, STUDY_QUERY, tag
from scanloom.operators.joins import may_be_among, split_hot_keys
from scanloom.operators.ordering import first_per_key, latest_per_key
from scanloom.session import drop_shuffles, release, settle, settle_bucketed

# Tag set of each shared extract, in the order that decides who gets a tag listed twice.
EXTRACTORS: dict[str, list[str]] = {
    "patient": PATIENT_QUERY,
    "study": STUDY_QUERY,
    "series": SERIES_EXTRACT,
    "image": IMAGE_EXTRACT,
}
KEPT_UIDS = ["SeriesInstanceUID", "SOPInstanceUID"]

DELETED = "deleted"
INSTANCE = "instance"


def _tag_sets(extractors: Mapping[str, list[str]]) -> dict[str, list[str]]:
    """The tags that each shared part gets: those of its set that no part before it has."""
    taken, sets = set(), {}
    for kind, keywords in extractors.items():
        sets[kind] = [k for k in keywords if k not in taken]
        taken.update(keywords)
    return sets


def _taken_apart(instances: DataFrame, extractors: Mapping[str, list[str]]) -> DataFrame:
    """Each dataset's own part ``_own`` and the shared ones ``_kind``, beside them the hashes ``_own_hash`` and ``_kind_hash``.

    The canonical lines of a dataset are written once, each with the number of its shared part (-1: none); a part's hash is
    that of its lines.
    """
    taken, codes, parts = set(), [], {}
    for kind, mine in _tag_sets(extractors).items():
        taken.update(extractors[kind])
        codes.append([tag(k) for k in mine])
        parts[f"_{kind}"] = project(F.col("ds"), mine)
    shared, kept = sorted(taken - set(KEPT_UIDS)), [tag(k) for k in KEPT_UIDS]

    def part_of(code: Column) -> Column:
        return reduce(lambda other, i: F.when(code.isin(*codes[i]), i).otherwise(other), reversed(range(len(codes))), F.lit(-1))

    def hashed(wanted: Callable[[Column], Column]) -> Column:
        return F.sha2(lines_text(F.filter("_lines", lambda x: wanted(x))), 256)

    for i, kind in enumerate(extractors):
        parts[f"_{kind}_hash"] = hashed(lambda x, i=i: x["part"] == i)
    own = {"_own": without(F.col("ds"), shared), "_own_hash": hashed(lambda x: (x["part"] == -1) | x["tag"].isin(*kept))}
    lines = canonical_lines(F.col("ds"), lambda code: part_of(code).alias("part"))
    return instances.withColumn("_lines", lines).withColumns({**parts, **own}).drop("_lines")


def split_extracts(instances: DataFrame, extractors: Mapping[str, list[str]] = EXTRACTORS) -> DataFrame:
    """Split each dataset: ``ds`` keeps the instance's own attributes, ``parts`` holds the shared
    extracts as ``array<struct<type, hash, ds>>``."""
    parts = [F.struct(F.lit(kind).alias("type"), F.col(f"_{kind}_hash").alias("hash"), F.col(f"_{kind}").alias("ds")) for kind in extractors]
    return _taken_apart(instances, extractors).select(
        *[c for c in instances.columns if c != "ds"], F.col("_own").alias("ds"), F.array(*parts).alias("parts")
    )


def extracts_of(split: DataFrame) -> DataFrame:
    """Each distinct extract of a type once: ``(hash, type, ds)``; copies combine before the shuffle.

    Rows are grouped by their values alone, so Spark hashes them and sorts nothing. Extracts of two types can have equal contents (both empty, say) and then share a hash, not a row.
    They travel as the bytes of the hash and JSON text in tag order, a fraction of a map's size in memory and on disk.
    """
    # The array is never empty. The outer form keeps Spark from adding a "not empty" filter,
    # which would compute every extract a second time below the explode.
    rows = split.select(F.explode_outer("parts").alias("p")).select(F.unhex("p.hash").alias("hash"), "p.type", packed(F.col("p.ds")).alias("ds"))
    once = rows.groupBy("hash", "type", "ds").agg(F.count(F.lit(1)).alias("_n"))
    return once.select(F.lower(F.hex("hash")).alias("hash"), "type", unpacked(F.col("ds")).alias("ds"))


def distinct_extracts(instances: DataFrame, extractors: Mapping[str, list[str]] = EXTRACTORS) -> DataFrame:
    """The same as :func:`extracts_of` the split instances, without their hashes.

    Equal extracts have equal texts, so only the texts travel, and the hash is taken once from each that is left.
    """
    parts = [F.struct(F.lit(kind).alias("type"), packed(project(F.col("ds"), mine)).alias("ds")) for kind, mine in _tag_sets(extractors).items()]
    rows = instances.select(F.explode_outer(F.array(*parts)).alias("p")).select("p.type", "p.ds")
    once = rows.groupBy("type", "ds").agg(F.count(F.lit(1)).alias("_n")).select("type", unpacked(F.col("ds")).alias("ds"))
    return once.select(content_hash(F.col("ds")).alias("hash"), "type", "ds")


def packed(ds: Column) -> Column:
    """A dataset as JSON text in tag order, the same for equal datasets."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(ds))))


def unpacked(text: Column) -> Column:
    """The dataset of such a text."""
    return F.from_json(text, DATASET_TYPE)


def references_of(split: DataFrame) -> DataFrame:
    """Instances with only their own attributes and the hashes of their extracts."""
    refs = F.transform("parts", lambda p: p["hash"])
    kept = [c for c in split.columns if c not in ("ds", "parts")]
    out = split.select(*kept, "ds", refs.alias("refs"), F.lit(INSTANCE).alias("type"))
    return out.withColumn("hash", instance_hash(F.col("ds"), F.col("refs")))


def instance_hash(ds: Column, refs: Column) -> Column:
    return joined_hash(content_hash(ds), refs)


def joined_hash(own_hash: Column, refs: Column) -> Column:
    return F.sha2(F.concat_ws("\n", own_hash, F.array_join(refs, "\n")), 256)


def deduplicate(
    instances: DataFrame, extractors: Mapping[str, list[str]] = EXTRACTORS
) -> tuple[DataFrame, DataFrame]:
    """``(extracts, instances with refs)`` of a table with one dataset ``ds`` per row.

    A job that writes both should materialise :func:`split_extracts` once and derive them from it.
    """
    # References need the hashes only, so the shared parts are not built for them.
    apart, refs = _taken_apart(instances, extractors), F.array(*[F.col(f"_{kind}_hash") for kind in extractors])
    kept = [c for c in instances.columns if c != "ds"]
    inst = apart.select(*kept, F.col("_own").alias("ds"), refs.alias("refs"), F.lit(INSTANCE).alias("type"), "_own_hash")
    inst = inst.withColumn("hash", joined_hash(F.col("_own_hash"), F.col("refs"))).drop("_own_hash")
    return distinct_extracts(instances, extractors), inst


def merged(own: Column, extracts: list[Column]) -> Column:
    """Datasets merged in order, NULL ones left out; an attribute that is already there stays."""
    return F.aggregate(
        F.array_compact(F.array(*extracts)), own,
        lambda acc, x: F.map_concat(acc, F.map_filter(x, lambda k, _: ~F.map_contains_key(acc, k))),
    )


def _first_wins(pieces: Column) -> Column:
    """Merge datasets, given as text, in order; an attribute that is already there stays."""
    ordered = F.transform(F.array_sort(pieces), lambda x: unpacked(x["ds"]))
    return F.aggregate(
        F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))),
        F.get(ordered, F.lit(0)),
        lambda acc, x: F.map_concat(acc, F.map_filter(x, lambda k, _: ~F.map_contains_key(acc, k))),
    )


def short(digest: Column) -> Column:
    """A hash as bytes, equal for equal texts only: hex digits in lower case take half their length, other texts stay."""
    raw = F.unhex(digest)
    return F.when(F.lower(F.hex(raw)) == digest, F.concat(F.lit(b"h"), raw)).otherwise(F.concat(F.lit(b"t"), digest.cast("binary")))


def recombine(
    instances: DataFrame, extracts: DataFrame, keys: list[str], extractors: Mapping[str, list[str]] = EXTRACTORS
) -> DataFrame:
    """Full datasets again: own values first, then the extracts in the order of the refs.

    ``missing_refs`` counts references whose extract is not there; such a dataset is incomplete. Only the references
    travel through the join on the hash, and datasets travel as text. The types are joined one after another, and what is found
    of one is written before the next, so the shuffles of one type are on disk at a time; both tables are read for each type.
    A dataset has a handful of refs, so the list that is merged per instance is short.
    """
    rest = F.coalesce(F.greatest(F.size("refs") - len(extractors), F.lit(0)), F.lit(0))  # refs of no type
    pieces = instances.select(*keys, F.lit(-1).cast("byte").alias("pos"), packed(F.col("ds")).alias("ds"), F.lit(True).alias("found"), rest.alias("missing"))
    for i, kind in enumerate(extractors):
        refs = instances.where(F.size("refs") > i).select(*keys, short(F.get("refs", F.lit(i))).alias("hash"))
        known = extracts.where(F.col("type") == kind).select(short(F.col("hash")).alias("hash"), packed(F.col("ds")).alias("ds"), F.lit(True).alias("found"))
        shared = refs.join(known, "hash", "left").withColumns({"found": F.coalesce("found", F.lit(False)), "pos": F.lit(i).cast("byte")})
        shared = settle(shared.select(*keys, "pos", "ds", "found", F.when(F.col("found"), 0).otherwise(1).alias("missing")), "zstd")
        pieces = pieces.unionByName(shared)
        drop_shuffles(instances.sparkSession)
    pieces = pieces.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("found"), F.struct("pos", "ds"))).alias("pieces"), F.sum("missing").alias("missing_refs")
    )
    return pieces.select(*keys, _first_wins(F.col("pieces")).alias("ds"), "missing_refs")


def set_hash(col: Column) -> Column:
    """Aggregate: hash of a multiset of hex digests of 64 digits, independent of order.

    Works on running XORs and sums instead of a collected list, so any number of members combines map-side into a few
    numbers. The sums tell apart what XORs cancel: members that occur twice.
    """
    words = [F.conv(F.substring(col, at, 8), 16, 10).cast("bigint") for at in range(1, 65, 8)]
    xors = [F.bit_xor(w).cast("string") for w in words]
    sums = [F.sum(w).cast("string") for w in words]  # words have 32 bits: room for 2^31 members
    return F.sha2(F.concat_ws(":", F.count(col).cast("string"), *xors, *sums), 256)


def new_instances(
    arrivals: DataFrame, existing: DataFrame, keys: list[str], version: list[str], force: bool = False
) -> DataFrame:
    """Arrivals whose object is not stored yet, the first of each; when forced, the newest of all."""
    if force:
        return latest_per_key(arrivals, keys, [F.col(v) for v in version])
    # First one row per object, which combines map-side, then the look-up.
    first = first_per_key(arrivals, keys, [F.col(v) for v in version])
    return first.join(existing.select(*keys).distinct(), keys, "left_anti")


def group_log(instances: DataFrame, source_files: DataFrame | None = None, dirty_only: bool = True) -> DataFrame:
    """Group record per study: hash of its instance set, counts, and the files it replaces.

    ``source_files(study_uid, file_hash)`` are the per-instance and older group files that
    were read; they become rows of :func:`group_refs`, not an array. With ``dirty_only`` a
    study is written only if it has new instances (column ``is_new``) or several files.
    """
    fresh = F.col("is_new") if "is_new" in instances.columns else F.lit(False)
    out = instances.groupBy("study_uid").agg(
        set_hash(F.col("hash")).alias("file_hash"),
        F.count(F.lit(1)).alias("n_instances"),
        F.count_if(fresh).alias("n_new"),
    )
    if source_files is None:
        return out
    read = source_files.groupBy("study_uid").agg(F.count(F.lit(1)).alias("n_files"))
    merged = out.join(read, "study_uid", "left")
    dirty = (F.col("n_new") > 0) | (F.coalesce(F.col("n_files"), F.lit(0)) > 1)
    return merged.where(dirty) if dirty_only else merged


def group_refs(group: DataFrame, source_files: DataFrame) -> DataFrame:
    """References of the group records: ``(study_uid, file_hash, ref)``."""
    read = split_hot_keys(source_files).select("study_uid", F.col("file_hash").alias("ref"))
    return group.select("study_uid", "file_hash").join(read, "study_uid").where("ref <> file_hash")


def unreferenced_files(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Files that no other file supersedes; only these need reading."""
    superseded = refs.select("study_uid", F.col("ref").alias("file_hash")).distinct()
    return files.join(superseded, ["study_uid", "file_hash"], "left_anti")


def deletable_files(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Plan of files that are referenced and so may be deleted."""
    superseded = refs.select("study_uid", F.col("ref").alias("file_hash")).distinct()
    return files.join(superseded, ["study_uid", "file_hash"], "left_semi")


def removable_folders(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Per study: number of files, number deletable, and may the folder go."""
    superseded = refs.select("study_uid", F.col("ref").alias("file_hash")).distinct().withColumn("_gone", F.lit(True))
    marked = files.join(superseded, ["study_uid", "file_hash"], "left")
    gone = F.col("_gone").isNotNull()
    return marked.groupBy("study_uid").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(gone).alias("n_deletable"),
        F.bool_and(gone).alias("removable"),
    )


def metadata_dirty(log: DataFrame, index: DataFrame) -> DataFrame:
    """Studies of the log and whether their metadata must be regenerated.

    ``log(study_uid, file_hash, n_new, n_files)``, ``index(study_uid, content_hash)``:
    dirty with new instances, more than one source file, no index, or another hash.
    """
    rows = log.join(index.select("study_uid", "content_hash"), "study_uid", "left")
    same = F.col("file_hash").eqNullSafe(F.col("content_hash"))
    return rows.withColumn("dirty", (F.col("n_new") > 0) | (F.col("n_files") > 1) | ~same)


def reject(instances: DataFrame, rejections: DataFrame) -> DataFrame:
    """Mark instances as deleted; a rejection without ``sop_uid`` takes the whole series."""
    series = (
        rejections.where("sop_uid IS NULL").select("study_uid", "series_uid").distinct().withColumn("_series", F.lit(True))
    )
    single = (
        rejections.where("sop_uid IS NOT NULL").select("study_uid", "series_uid", "sop_uid").distinct()
        .withColumn("_single", F.lit(True))
    )
    # The wider key first: the second join then has a shuffle of its own, whose skew Spark can split.
    marked = split_hot_keys(instances).join(single, ["study_uid", "series_uid", "sop_uid"], "left").join(
        series, ["study_uid", "series_uid"], "left"
    )
    kind = F.when(F.col("_series").isNotNull() | F.col("_single").isNotNull(), DELETED).otherwise(F.col("type"))
    return marked.select(*[F.col(c) for c in instances.columns if c != "type"], kind.alias("type"))


def live(instances: DataFrame) -> DataFrame:
    return instances.where(F.col("type") != DELETED)


def update_attributes(instances: DataFrame, replacements: DataFrame, keys: list[str]) -> DataFrame:
    """Point references to corrected extracts: ``replacements(old_hash, new_hash)``, with ``at`` where one hash has several.

    Every instance stays, with its refs as they are where none of them is replaced. Of several replacements of one hash the
    one with the latest ``at`` counts, of equally late ones the largest new hash. All are applied at once: a hash that
    comes in by one replacement is not replaced by another of the same call.

    Only references that may be replaced, and only instances that have one of them, are moved.
    """
    latest = [F.col("at")] if "at" in replacements.columns else []
    one = replacements.where("new_hash IS NOT NULL").groupBy("old_hash").agg(F.max_by("new_hash", F.struct(*latest, "new_hash")).alias("new_hash"))
    refs = instances.select(*keys, F.explode("refs").alias("old_hash"))
    digest, key = F.xxhash64("old_hash"), F.xxhash64(*keys)
    refs = settle(refs.where(may_be_among(replacements.where("new_hash IS NOT NULL").select(digest.alias("key")))(digest)), "zstd")
    touched = may_be_among(refs.select(key.alias("key")))(key)
    drop_shuffles(instances.sparkSession)
    hits = refs.join(one, "old_hash").select(*keys, F.struct("old_hash", "new_hash").alias("r"))
    # One instance has a handful of refs, so this map is short.
    swaps = hits.groupBy(*keys).agg(F.map_from_entries(F.collect_set("r")).alias("_swaps"))
    swapped = F.transform("refs", lambda r: F.coalesce(F.element_at("_swaps", r), r))
    marked = instances.where(touched).join(swaps, keys, "left").select(
        *[F.col(c) if c != "refs" else F.when(F.col("_swaps").isNull(), F.col("refs")).otherwise(swapped).alias("refs") for c in instances.columns]
    )
    return marked.unionByName(instances.where(~touched))


def split_study(instances: DataFrame, moved: DataFrame, new_study: Column) -> DataFrame:
    """Move series to another study: tombstones under the old UID, rows under the new one."""
    flags = moved.select("study_uid", "series_uid").distinct().withColumn("_moved", F.lit(True))
    marked = instances.join(flags, ["study_uid", "series_uid"], "left")
    stay = F.struct(F.col("study_uid").alias("uid"), F.col("type").alias("kind"))
    gone = F.struct(F.col("study_uid").alias("uid"), F.lit(DELETED).alias("kind"))
    arrived = F.struct(new_study.alias("uid"), F.col("type").alias("kind"))
    out = F.when(F.col("_moved").isNull(), F.array(stay)).otherwise(F.array(gone, arrived))
    rows = marked.withColumn("_out", F.explode_outer(out))
    kept = [c for c in instances.columns if c not in ("study_uid", "type")]
    return rows.select(F.col("_out.uid").alias("study_uid"), *kept, F.col("_out.kind").alias("type"))


def extracts_used(instances: DataFrame, extractors: Mapping[str, list[str]] = EXTRACTORS) -> DataFrame:
    """``(study_uid, type, hash)`` of every reference; the position of a ref tells its type."""
    kinds = F.array(*[F.lit(k) for k in extractors])
    refs = instances.select("study_uid", F.posexplode_outer("refs").alias("pos", "hash"))
    return refs.select("study_uid", F.get(kinds, F.col("pos")).alias("type"), "hash")


def dedup_stats(extracts_used: DataFrame, instances: DataFrame) -> DataFrame:
    """Per study: distinct extracts by type, instances, and the hash of the instance set.

    ``extracts_used`` has one row per (study, extract): ``study_uid, type, hash``. Hashes travel as bytes.
    """
    distinct = extracts_used.select("study_uid", "type", short(F.col("hash")).alias("hash")).distinct()
    kinds = distinct.groupBy("study_uid").agg(
        F.count(F.lit(1)).alias("n_extracts"),
        *[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in EXTRACTORS],
    )
    per_study = instances.groupBy("study_uid").agg(
        F.count(F.lit(1)).alias("n_instances"), set_hash(F.col("hash")).alias("info_hash")
    )
    return per_study.join(kinds, "study_uid", "left")


class TooDeep(RuntimeError):
    """References are chained deeper than the given bound."""


def newest_superseders(files: DataFrame, refs: DataFrame, depth: int = 200) -> DataFrame:
    """Every file with the newest file that reaches it along references, itself included: adds ``by`` and ``superseded``.

    ``files(study_uid, file_hash, mtime, ...)`` are the files that are there, ``refs(study_uid, file_hash, ref)`` says what
    a file replaces, also for files that have gone since. A file is superseded when a newer one (by mtime, then hash) that
    is there reaches it, over any number of files, gone ones included; so of files that replace each other in a circle
    the newest stays, and what only a lost file replaces stays too.

    The newest label travels along the references, one step a round, and only labels that grew travel on: a round handles
    one row per file, never pairs of files. Files, references and grown labels lie in buckets by file, so a round moves the
    labels it sends and nothing else, and writes those that grew. More than ``depth`` rounds raise :class:`TooDeep`.
    """
    key = ["study_uid", "file_hash"]
    spark = files.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.struct("mtime", "file_hash")
    edges = settle_bucketed(refs.where("file_hash <> ref").select(*key, "ref").repartition(buckets, *key).distinct(), key, buckets, placed=True)
    first = files.select(*key, "mtime").repartition(buckets, *key).groupBy(*key).agg(F.max("mtime").alias("mtime"))
    labels = settle_bucketed(first.select(*key, own.alias("label")), key, buckets, placed=True)
    frontier, grown = labels, []
    for _ in range(depth):
        sent = frontier.join(edges, key).groupBy("study_uid", F.col("ref").alias("file_hash")).agg(F.max("label").alias("_new"))
        known, label = _with_labels(sent, labels, grown, key)
        fresh = known.where(label.isNull() | (F.col("_new") > label)).select(*key, F.col("_new").alias("label"))
        frontier = settle_bucketed(fresh, key, buckets, placed=True)
        if frontier.isEmpty():
            release(frontier)
            break
        grown.append(frontier)
        drop_shuffles(spark)
        if len(grown) == MERGED_ROUNDS:
            # Joined, not united: Spark takes a union of bucketed tables as dealt out alike even where it reads them otherwise,
            # and leaves out a repartition that would mend it. The last round's labels are the frontier and stay.
            merged_labels = settle_bucketed(reduce(lambda a, b: _newest_labels(a, b, key), grown), key, buckets)
            release(*grown[:-1])
            grown = [merged_labels]
    else:
        raise TooDeep(f"references are chained deeper than {depth}")
    release(edges)
    known, label = _with_labels(files, labels, grown, key)
    return known.select(*[F.col(c) for c in files.columns], label["file_hash"].alias("by"), (label > own).alias("superseded"))


#: So many rounds of grown labels are looked up one by one before they become one table.
MERGED_ROUNDS = 8


def _newest_labels(one: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """The larger label of every file of two tables, which have a file once at most."""
    both = one.join(other.withColumnRenamed("label", "_other"), key, "full_outer")
    return both.select(*key, F.greatest("label", "_other").alias("label"))


def _with_labels(rows: DataFrame, labels: DataFrame, grown: list[DataFrame], key: list[str]) -> tuple[DataFrame, Column]:
    """Rows with what is known of their files, and the newest label, NULL if there is none."""
    names = [f"_label{i}" for i in range(len(grown) + 1)]
    for name, known in zip(names, [labels, *grown], strict=True):
        rows = rows.join(known.select(*key, F.col("label").alias(name)), key, "left")
    return rows, F.greatest(*names) if grown else F.col(names[0])


def readable_files(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Files that no newer file reaches; together they hold everything."""
    return newest_superseders(files, refs).where("NOT superseded").drop("by", "superseded")
