"""Summaries kept up by changes, replicas brought together, chains of references, look-ups by UID."""

import random

import pytest
from pyspark.sql import functions as F

from scanloom.operators import consistency as C
from scanloom.operators import dedup as D
from scanloom.operators import rollup as R
from scanloom.operators.stored import joined_in_place
from scanloom.session import new_folder, settle_bucketed
from scanloom.sources import sinks as K

SCHEMA = "study_uid string, series_uid string, sop_uid string, instance_number bigint, series_number bigint, modality string"
ATTRIBUTES = ["series_number", "modality"]


def as_df(spark, objects):
    return spark.createDataFrame([(*o[:2], uid, *o[2:]) for uid, o in objects.items()], SCHEMA)


def full(spark, objects):
    return {tuple(r) for r in R.summaries(R.series_state(as_df(spark, objects), ATTRIBUTES)).collect()}


def test_rollup_equals_a_full_build(spark):
    rnd = random.Random(4)

    def fresh(uid):
        study = rnd.choice(["1.1", "1.2", "1.3", None])
        return (study, f"{study}.{rnd.randrange(4)}", rnd.choice([None, 1, 2, 3, 4, 5]), rnd.randrange(3), f"m{uid}")

    objects = {f"i{i}": fresh(i) for i in range(120)}
    state = R.series_state(as_df(spark, objects), ATTRIBUTES)
    for step in range(4):
        changes = []
        for uid in rnd.sample(sorted(objects), 30):
            if rnd.random() < 0.5:
                changes.append(("delete", *objects[uid][:2], uid, *objects.pop(uid)[2:]))
            else:
                old = objects[uid]
                objects[uid] = (*old[:2], rnd.choice([None, 0, 1, 9]), old[3], f"u{step}")
                changes.append(("update", *objects[uid][:2], uid, *objects[uid][2:]))
        for i in range(15):
            uid = f"n{step}.{i}"
            objects[uid] = fresh(uid)
            changes.append(("insert", *objects[uid][:2], uid, *objects[uid][2:]))
        batch = spark.createDataFrame(changes, "op string, " + SCHEMA)
        state = R.roll_up(state, batch, ATTRIBUTES, R.reader_of(as_df(spark, objects)))
        assert {tuple(r) for r in R.summaries(state).collect()} == full(spark, objects)


def test_inserts_read_no_instances(spark):
    objects = {f"i{i}": ("1.1", f"1.1.{i % 3}", i, 1, "CT") for i in range(9)}
    state = R.series_state(as_df(spark, objects), ATTRIBUTES)

    def never(series):
        raise AssertionError("instances were read")

    changes = [("insert", "1.1", "1.1.0", "new", -1, 1, "MR"), ("update", "1.1", "1.1.1", "i1", 0, 1, "PT"), ("delete", "1.1", "1.1.2", "i8", 8, 1, "CT")]
    out = R.roll_up(state, spark.createDataFrame(changes, "op string, " + SCHEMA), ATTRIBUTES, never)
    assert {(r.series_uid, r.modality, r.n_instances) for r in R.summaries(out).collect()} == {("1.1.0", "MR", 4), ("1.1.1", "PT", 3), ("1.1.2", "CT", 2)}
    assert R.roll_up(out, spark.createDataFrame([], "op string, " + SCHEMA), ATTRIBUTES, never).count() == 3


def test_only_stale_buckets_are_read(spark, tmp_path):
    objects = {f"i{i}": (f"1.{i % 20}", f"1.{i % 20}.0", i, 1, "CT") for i in range(200)}
    gone = objects.pop("i3")
    K.write_archive(as_df(spark, objects), str(tmp_path / "a"), buckets=16)
    archive = K.read_archive(spark, str(tmp_path / "a"))
    read = R.bucket_reader(archive, lambda s: K.study_bucket(s, 16))
    stale = spark.createDataFrame([("1.3", "1.3.0")], "study_uid string, series_uid string")
    rows = read(stale)
    assert "PartitionFilters: [study_bucket" in rows._jdf.queryExecution().executedPlan().toString() or "study_bucket" in rows._jdf.queryExecution().optimizedPlan().toString()
    state = R.series_state(as_df(spark, {**objects, "i3": gone}), ATTRIBUTES)
    out = R.roll_up(state, spark.createDataFrame([("delete", *gone[:2], "i3", *gone[2:])], "op string, " + SCHEMA), ATTRIBUTES, read)
    assert {tuple(r) for r in R.summaries(out).collect()} == full(spark, objects)


OBJECT = "study_uid string, sop_uid string, version bigint, content_hash string"


def replica(spark, rows, buckets=8):
    return C.Replica(spark.createDataFrame(rows, OBJECT), ["sop_uid"], buckets=buckets)


def contents(replica):
    return {(r.study_uid, r.sop_uid, r.version, r.content_hash) for r in replica.objects().collect()}


def test_replicas_become_consistent(spark):
    base = [(f"s{i % 30}" if i % 31 else None, f"o{i}", 1, f"h{i}") for i in range(300)]
    left = replica(spark, [r for r in base if r[1] != "o5"] + [("s7", "o7", 2, "new")])
    right = replica(spark, [r for r in base if r[1] != "o9"] + [("s8", "o38", 1, "z")])
    late = spark.createDataFrame([("s11", "late", 1, "x")], OBJECT)
    log = C.make_consistent(left, right, meanwhile=lambda n: (None, late if n == 1 else None)).collect()
    assert [(r.round, r.to_left, r.to_right) for r in log] == [(1, 2, 2), (2, 1, 0), (3, 0, 0)]
    # Only differing buckets were read: fewer objects than the replicas hold, and in the second round one bucket's.
    assert log[0].n_read < 600 and log[0].n_studies == 4 and log[1].n_buckets == 1 and log[1].n_read < log[0].n_read
    assert contents(left) == contents(right)
    merged = {(s, o): (v, h) for s, o, v, h in base}
    merged.update({("s7", "o7"): (2, "new"), ("s8", "o38"): (1, "z"), ("s11", "late"): (1, "x")})
    assert contents(left) == {(*k, *v) for k, v in merged.items()}
    assert [tuple(r) for r in C.make_consistent(left, right).collect()] == [(1, 0, 0, 0, 0, 0)]


def test_only_touched_studies_are_digested_again(spark):
    side = replica(spark, [(f"s{i % 6}" if i % 7 else None, f"o{i}", 1, "h") for i in range(40)], buckets=2)
    more = spark.createDataFrame([("s1", "o1", 2, "new"), (None, "x", 1, "h")], OBJECT)
    digested, before = [], side._study_digests
    side._study_digests = lambda objects: digested.append(objects) or before(objects)
    side.add(more)
    side.refresh(more)
    assert {r.study_uid for r in digested[0].collect()} == {"s1", None}
    whole = before(side.objects())
    assert {tuple(r) for r in side._studies.collect()} == {tuple(r) for r in whole.collect()}
    assert side.digests == side._bucket_digests(whole)


def test_set_hash_state_is_of_plain_numbers(spark):
    from scanloom.operators.dedup import set_hash

    df = spark.range(5).select((F.col("id") % 2).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    assert "decimal" not in df.groupBy("g").agg(set_hash(F.col("h")))._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_are_bounded(spark):
    left, right = replica(spark, [("s", "a", 1, "h")]), replica(spark, [("s", "b", 1, "h")])
    more = lambda n: (spark.createDataFrame([("s", f"n{n}", 1, "h")], OBJECT), None)
    with pytest.raises(C.NotConsistent):
        C.make_consistent(left, right, rounds=2, meanwhile=more)


def test_empty_replica_is_filled(spark):
    left, right = replica(spark, []), replica(spark, [("s", "b", 1, None), (None, "c", 2, "h")])
    C.make_consistent(left, right)
    assert contents(left) == contents(right) and len(contents(left)) == 2


def test_chains_and_circles(spark):
    files = spark.createDataFrame(
        [("s", f"f{i}", i) for i in range(6)] + [("s", "lone", 0), ("c", "a", 1), ("c", "b", 2), ("c", "c", 3), ("g", "old", 1), ("g", "new", 9), ("x", "late", 5), ("x", "early", 4)],
        "study_uid string, file_hash string, mtime bigint",
    )
    refs = spark.createDataFrame(
        [("s", f"f{i + 1}", f"f{i}") for i in range(5)] + [("c", "a", "b"), ("c", "b", "c"), ("c", "c", "a"), ("c", "a", "a")]
        + [("g", "new", "gone1"), ("g", "gone1", "gone2"), ("g", "gone2", "old"), ("g", "lost", "new")] + [("x", "early", "late"), ("y", "none", "nothing")],
        "study_uid string, file_hash string, ref string",
    )
    rows = {(r.study_uid, r.file_hash): (r.by, r.superseded) for r in D.newest_superseders(files, refs).collect()}
    assert rows["s", "f0"] == ("f5", True) and rows["s", "f5"] == ("f5", False) and rows["s", "lone"] == ("lone", False)
    assert rows["c", "c"] == ("c", False) and rows["c", "a"] == ("c", True) and rows["c", "b"] == ("c", True)
    assert rows["g", "old"] == ("new", True) and rows["g", "new"] == ("new", False)
    assert rows["x", "late"] == ("late", False)  # what an older file names stays
    assert {r.file_hash for r in D.readable_files(files, refs).collect()} == {"f5", "lone", "c", "new", "late", "early"}
    with pytest.raises(D.TooDeep):
        D.newest_superseders(files, refs, depth=2)


def scanned_rows(df):
    """Rows that the file scan of a plan gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    if "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan()
        while plan.children().size():
            plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_look_up_by_uid_skips_row_groups(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.lit("1.1").alias("study_uid"), F.concat(F.lit("1.1."), (F.col("id") % 5).cast("string")).alias("series_uid"),
        F.concat(F.lit("2."), F.sha2(F.col("id").cast("string"), 256)).alias("sop_uid"), F.col("id").alias("n"),
    )
    uid = rows.where("n = 777").first().sop_uid
    missing = "2." + "8" * 64
    seen = {}
    for name, columns in (("with", K.LOOKED_UP), ("without", ())):
        path = str(tmp_path / name)
        spark.conf.set("parquet.block.size", "100000")
        # Sorted by study and series only, UIDs lie anywhere.
        placed = rows.withColumn("study_bucket", F.lit(0)).orderBy(F.xxhash64("n"))
        K.with_bloom_filters(placed.coalesce(1).write.option("parquet.block.size", 200_000).option("parquet.enable.dictionary", "false"), columns).parquet(path)
        archive = K.read_archive(spark, path)
        assert [r.n for r in K.find_objects(archive, [uid, missing]).collect()] == [777]
        seen[name] = (scanned_rows(K.find_objects(archive, [missing]).select("n")), scanned_rows(K.find_objects(archive, [uid]).select("n")))
    assert seen["with"][0] == 0 and seen["with"][1] < seen["without"][1] and seen["without"][0] > 10_000, seen


def test_chunked_values(spark, tmp_path):
    rnd = random.Random(2)
    data = {i: bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 99, 100, 101, 1000]))) for i in range(30)}
    data.update({40: data[3], 41: data[3], 42: b""})
    df = spark.createDataFrame([*data.items(), (50, None)], "id bigint, content binary")
    chunks = K.chunk_rows(df, "id", "content", 100).orderBy(F.xxhash64("id", "part"))
    contents, stored = K.chunked_bulkdata(chunks, "id")
    import hashlib

    want = {}
    for i, c in sorted(data.items()):
        want.setdefault(hashlib.sha256(c).hexdigest(), [i, len(c), max(1, -(-len(c) // 100)), 0])[3] += 1
    assert {r.hash: [r.first_user, r.size, r.n_parts, r.n_users] for r in contents.collect()} == want
    path = str(tmp_path / "c")
    K.write_chunks(stored, path)
    K.write_chunks(stored, path, existing=spark.read.parquet(path))
    assert spark.read.parquet(path).count() == sum(v[2] for v in want.values())
    for digest in list(want)[:5]:
        joined = b"".join(bytes(r.content) for r in K.read_chunks(spark, path, digest).collect())
        assert hashlib.sha256(joined).hexdigest() == digest
    assert K.chunked_digests(chunks.limit(0), "id").collect() == []


def test_no_content_in_aggregations(spark):
    df = spark.range(5).select("id", F.col("id").cast("string").cast("binary").alias("content"))
    _, stored = K.chunked_bulkdata(K.chunk_rows(df, "id", "content", 2), "id")
    assert "Aggregate" not in stored._jdf.queryExecution().executedPlan().toString()


def test_rollup_moves_nothing_between_series_buckets(spark):
    objects = {f"i{i}": (None if i % 7 == 0 else f"1.{i % 5}", f"1.{i % 5}.{i % 3}", i % 11, 1, f"m{i}") for i in range(150)}
    state = settle_bucketed(R.series_state(R.with_series_cell(as_df(spark, objects)), ATTRIBUTES), ["cell"], 4)
    changes = []
    for i in range(0, 150, 4):
        old = objects.pop(f"i{i}")
        changes.append(("delete", *old[:2], f"i{i}", *old[2:]))
    for i in range(1, 150, 4):
        old = objects[f"i{i}"]
        objects[f"i{i}"] = (*old[:2], old[2] + 20, old[3], "u")
        changes.append(("update", *objects[f"i{i}"][:2], f"i{i}", *objects[f"i{i}"][2:]))
    objects["n"] = (None, "1.0.9", 3, 1, "new")
    changes.append(("insert", None, "1.0.9", "n", 3, 1, "new"))
    batch = settle_bucketed(R.with_series_cell(spark.createDataFrame(changes, "op string, " + SCHEMA)), ["cell"], 4)
    after = settle_bucketed(R.with_series_cell(as_df(spark, objects)), ["cell"], 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with joined_in_place(spark):
            merged = R.merge_changes(state, batch, ATTRIBUTES)
            plan = merged._jdf.queryExecution().executedPlan().toString()
            looked_up = R.series_state(R.reader_of(after)(state.select("cell", *R.SERIES)), ATTRIBUTES)._jdf.queryExecution().executedPlan().toString()
        out = {tuple(r) for r in R.summaries(R.roll_up(state, batch, ATTRIBUTES, R.reader_of(after))).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange" not in plan and "Exchange" not in looked_up
    assert out == full(spark, objects)
