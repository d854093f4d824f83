import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from scanloom.sources import documents as D
from scanloom.sources import files as L
from scanloom.sources import sinks as K
from scanloom.streaming import ingest as S
from scanloom.streaming import messages as M


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_scan_skips_hidden_and_missing(spark, tmp_path):
    root = str(tmp_path / "in")
    for name in ("a.dcm", "sub/b", "sub/note.TXT", "__MACOSX/x", "sub/.hidden/y", "DICOMDIR"):
        put(f"{root}/{name}", b"abc")
    found = {r.path.split("/in/")[1] for r in D.scan_files(spark, [root, str(tmp_path / "nowhere")]).collect()}
    assert found == {"a.dcm", "sub/b", "sub/note.TXT", "DICOMDIR"}
    names = {r.path.split("/in/")[1] for r in D.input_files(spark, root).collect()}
    assert names == {"a.dcm", "sub/b"}
    assert D.scan_files(spark, str(tmp_path / "nowhere")).count() == 0
    listing = {r.key: (r.size, r.file_name) for r in D.list_objects(spark, root).collect()}
    assert listing["sub/b"] == (3, "sub/b.gz")


def test_listing_is_done_by_tasks(spark, tmp_path):
    for name in ("a/b/c/d/x", "a/b/y", "a/.h/z", "top", "a/__MACOSX/q", ".dot"):
        put(f"{tmp_path}/.in/{name}", b"1234")
    os.makedirs(f"{tmp_path}/.in/empty/deep")
    root = f"file://{tmp_path}/.in"
    found = L.list_tree(spark, [root, root + "/", root + "/nowhere", root + "/top"])
    assert sorted((r.relative, r.path, r.length) for r in found.collect()) == sorted(
        [*((n, f"{root}/{n}", 4) for n in ("a/b/c/d/x", "a/b/y", "top", "top"))]
    )
    every = {r.relative for r in L.list_tree(spark, root, hidden=True).collect()}
    assert every == {"a/b/c/d/x", "a/b/y", "a/.h/z", "top", "a/__MACOSX/q", ".dot"}
    assert L.list_tree(spark, []).count() == 0
    os.symlink(f"{tmp_path}/.in/a", f"{tmp_path}/.in/a/b/loop")
    with pytest.raises(ValueError, match="nested"):
        L.list_tree(spark, root, depth=9)


def test_many_folders_spread_over_tasks(spark, tmp_path, monkeypatch):
    for i in range(40):
        put(f"{tmp_path}/r/f{i}/x{i}", b"x" * i)
    monkeypatch.setattr(L, "FOLDERS", 4)
    files = L.list_tree(spark, str(tmp_path / "r"))
    assert {(r.relative, r.length) for r in files.collect()} == {(f"f{i}/x{i}", i) for i in range(40)}
    levels = [f for f in files.inputFiles()]
    assert len(levels) > 5  # several tasks listed the second level


def test_contents_and_ranges(spark, tmp_path, monkeypatch):
    data = {f"d/f{i}": bytes([i]) * (i * 1000) for i in range(12)}
    rows = spark.createDataFrame([*data.items(), ("d/none", None)], "path string, content binary")
    root = f"file://{tmp_path}/w"
    assert {(r.path, r.length) for r in L.write_files(rows, root).collect()} == {(p, len(c)) for p, c in data.items()} | {("d/none", 0)}
    monkeypatch.setattr(L, "BATCH", 5000)
    monkeypatch.setattr(L, "BYTES", 20_000)
    listed = L.list_tree(spark, root)
    got = {r.relative: bytes(r.content) for r in L.read_contents(listed).collect()}
    assert got == {**data, "d/none": b""}
    gone = listed.limit(1).withColumn("path", F.concat("path", F.lit("-gone")))
    assert [r.content for r in L.read_contents(gone).collect()] == [None]


def test_payload_slices(spark, tmp_path):
    payload = bytes(range(256)) * 40
    put(str(tmp_path / "m" / "a.mht"), b"--B\r\nContent-Type: image/jls\r\n\r\n" + payload + b"\r\n--B--\r\n")
    put(str(tmp_path / "m" / "no-end.mht"), b"--B\r\nContent-Type: image/jls\r\n\r\n" + payload)
    put(str(tmp_path / "m" / "no-break.mht"), b"--B\r\nContent-Type: image/jls\r\n\r\nxy\r\n--B--")
    put(str(tmp_path / "m" / "long-head.mht"), b"--B\r\nX: " + b"h" * 9000 + b"\r\nContent-Type: a/b; transfer-syntax=1.2\r\n\r\nz\r\n--B--\r\n")
    put(str(tmp_path / "m" / "empty"), b"")
    put(str(tmp_path / "m" / "dashes"), b"-- no header")
    headers = L.multipart_headers(L.list_tree(spark, str(tmp_path / "m")))
    by = {}
    for r in L.payload_slices(headers, 1000).orderBy("relative", "part").collect():
        by.setdefault(r.relative, []).append((r.part, bytes(r.content), r.content_type, r.transfer_syntax))
    whole = {n: b"".join(x[1] for x in v) for n, v in by.items()}
    assert whole == {"a.mht": payload, "no-end.mht": payload, "no-break.mht": b"xy", "long-head.mht": b"z", "empty": b"", "dashes": b"-- no header"}
    assert [x[0] for x in by["a.mht"]] == list(range(11)) and by["long-head.mht"][0][2:] == ("a/b", "1.2")
    assert by["dashes"][0][2] == "application/octet-stream"


def test_read_documents_quarantines(spark, tmp_path):
    doc = {"00080018": {"vr": "UI", "Value": ["1.2"]}, "00101002": {"vr": "SQ", "Value": [{"00100020": {"vr": "LO", "Value": ["A"]}}]}}
    put(str(tmp_path / "d" / "good.json"), json.dumps(doc).encode())
    put(str(tmp_path / "d" / "list.json.gz"), gzip.compress(json.dumps([doc, doc]).encode()))
    put(str(tmp_path / "d" / "cut.json"), b'{"0008')
    put(str(tmp_path / "d" / "empty.json"), b"")
    good, bad = D.split_documents(D.read_documents(spark, str(tmp_path / "d")))
    assert good.count() == 2
    put(str(tmp_path / "e" / "torn.json.gz"), gzip.compress(b"{}")[:-6])
    put(str(tmp_path / "e" / "bytes.json"), b"\xff\xfe{}")
    assert {r.ok for r in D.read_documents(spark, str(tmp_path / "e")).collect()} == {False}
    assert {r.path.rpartition("/")[2] for r in bad.collect()} == {"cut.json", "empty.json"}
    assert D.as_datasets(good.select("path", "document")).where("ds['00080018'].Value[0] = '1.2'").count() == 3


@pytest.mark.parametrize(
    "data, kind, syntax, payload",
    [
        (b"--B\r\nContent-Type: image/jls;transfer-syntax=1.2.3; a=b\r\nContent-Location: 1\r\n\r\n\x00\xff--x\r\n--B--\r\n", "image/jls", "1.2.3", b"\x00\xff--x"),
        (b"--B\r\nContent-Type: image/png\r\n\r\nxy\r\n--B--\r\n", "image/png", None, b"xy"),
        (b"\x89plain", "application/octet-stream", None, b"\x89plain"),
        (b"--B\r\nX: 1\r\n\r\n\r\n--B--\r\n", "application/octet-stream", None, b""),
    ],
)
def test_multipart(spark, tmp_path, data, kind, syntax, payload):
    put(str(tmp_path / "m" / "f.mht"), data)
    r = D.read_multipart(spark, str(tmp_path / "m")).first()
    assert (r.content_type, r.transfer_syntax, bytes(r.payload)) == (kind, syntax, payload)


def test_archive_round_trip(spark, tmp_path):
    rows = [(f"1.{i % 7}", f"1.{i % 7}.{i % 3}", f"1.{i}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "study_uid string, series_uid string, sop_uid string, n int")
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        K.write_archive(df, path, fmt, buckets=4)
        back = K.read_archive(spark, path, fmt)
        assert sorted(tuple(r) for r in back.select(*df.columns).collect()) == sorted(rows)
        one = K.read_study(back, "1.3", buckets=4)
        assert one.count() == sum(r[0] == "1.3" for r in rows)
        assert "PartitionFilters: [isnotnull(study_bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_bulkdata_is_stored_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 5}".encode()) for i in range(40)], "id int, content binary")
    rows = K.bulkdata_rows(df, "content", "id")
    path = str(tmp_path / "bulk")
    K.write_bulkdata(rows, path)
    K.write_bulkdata(rows, path, existing=spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 5


def arrivals(seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        study = "1.0" if rnd.random() < 0.4 else f"1.{rnd.randrange(1, 9)}"
        k = rnd.randrange(30)
        rows.append((study, f"{study}.{rnd.randrange(3)}", f"{study}.i{k}", rnd.randrange(3), k, rnd.choice("CM"), 1, i))
    return rows


SCHEMA = "study_uid string, series_uid string, sop_uid string, series_number bigint, instance_number bigint, modality string, n_frames int, t int"


@pytest.mark.parametrize("keep", ["newest", "first"])
def test_archive_is_independent_of_arrival_order(spark, tmp_path, keep):
    rows = arrivals(3)
    results = []
    for run in range(2):
        shuffled = list(rows)
        random.Random(run).shuffle(shuffled)
        archive = S.ArchiveStream(str(tmp_path / f"{keep}{run}"), keep=keep, buckets=3)
        pieces = [rows] if run == 0 else [shuffled[i::5] for i in range(5)]
        for n, piece in enumerate(pieces):
            batch = spark.createDataFrame(piece, SCHEMA).withColumn("version", F.timestamp_seconds("t"))
            archive.process(batch, n)
            if n == 2:
                archive.process(batch, n)  # a batch that is run again changes nothing
            if n == 3:
                archive = archive.compact(spark, str(tmp_path / f"{keep}-compact"))
        studies = sorted((r.study_uid, r.n_series, r.n_instances, tuple(r.modalities)) for r in archive.studies(spark).collect())
        series = sorted(tuple(r) for r in archive.series(spark).select("study_uid", "series_uid", "modality", "n_instances").collect())
        assert sum(s[2] for s in studies) == sum(s[3] for s in series) == archive.instances(spark).count()
        results.append((studies, series))
    assert results[0] == results[1]


def test_work_of_a_batch_does_not_grow(spark, tmp_path):
    root = tmp_path / "archive"
    archive = S.ArchiveStream(str(root), buckets=3)
    read = []
    for n in range(6):
        batch = spark.createDataFrame(arrivals(n)[:20], SCHEMA).where("study_uid = '1.0'").withColumn("version", F.timestamp_seconds("t"))
        archive.process(batch, n)
        read.append(len(archive.instances(spark).inputFiles()))
    assert read == [1] * 6  # one bucket, which every batch replaces
    assert archive.instances(spark).groupBy("sop_uid").count().where("count > 1").count() == 0


def test_a_new_stream_goes_on_with_what_is_stored(spark, tmp_path):
    whole = S.ArchiveStream(str(tmp_path / "whole"), buckets=3)
    parts = [spark.createDataFrame(arrivals(n)[:60], SCHEMA).withColumn("version", F.timestamp_seconds("t")) for n in range(3)]
    for n, batch in enumerate(parts):
        whole.process(batch, n)
        S.ArchiveStream(str(tmp_path / "again"), buckets=3).process(batch, 0)  # numbers start at 0 with a new checkpoint
    again = S.ArchiveStream(str(tmp_path / "again"), buckets=3)
    count = lambda a: {(r.study_uid, r.n_series, r.n_instances) for r in a.studies(spark).collect()}
    assert count(again) == count(whole) and again.instances(spark).count() == whole.instances(spark).count()
    archive = S.ArchiveStream(str(tmp_path / "none"), buckets=3)
    archive.process(parts[0].limit(0), 0)
    assert archive.studies(spark).count() == 0


def test_sessions_on_stream_and_table_agree(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(rnd.randrange(4), rnd.randrange(4000)) for _ in range(300)] + [(9, 0), (9, 60), (9, 121)]
    df = spark.createDataFrame(rows, "k int, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    flush = spark.createDataFrame([(99, 10**6)], "k int, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    src = str(tmp_path / "src")
    df.coalesce(1).write.parquet(src)
    flush.coalesce(1).write.mode("append").parquet(src)
    out = S.settled_stream(S.file_stream(spark, src, df.schema, files_per_batch=1), "k", "ts", "60 seconds", "5000 seconds")
    q = out.writeStream.format("memory").queryName("sessions").outputMode("append")
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    streamed = {tuple(r) for r in spark.table("sessions").collect()}
    batch = {tuple(r) for r in S.settled_sessions(df, "k", "ts", 60).collect()}
    assert streamed == batch


def test_stream_dedup_keeps_old_and_late_rows(spark, tmp_path):
    schema = "sop_uid string, hash string, s int"
    src = str(tmp_path / "src")
    for base in (10**8, 0, 10**7):  # the second and third file hold much older rows
        rows = [(f"u{(base // 10**7 + i) % 30}", f"h{i % 2}", base + i) for i in range(40)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stored = spark.read.parquet(src)
    seen = S.SeenTable(str(tmp_path / "seen"), ["sop_uid", "hash"], "sop_uid string, hash string", buckets=3)
    seen.run(S.drop_seen(S.file_stream(spark, src, schema, files_per_batch=1), ["sop_uid", "hash"], "1 hour"))
    got = sorted(tuple(r) for r in seen.read(spark).collect())
    assert got == sorted(tuple(r) for r in stored.select("sop_uid", "hash").distinct().collect())
    # A second run over the same rows in another stage adds nothing.
    seen.process(stored, 99)
    assert seen.read(spark).count() == len(got)


def test_queue_retries_and_gives_up(spark, tmp_path):
    rows = [("t", str(i), str(i), f"m{i}", 0) for i in range(6)]
    batch = spark.createDataFrame(rows, "type string, id string, data string, message_id string, s int").withColumn("sent_at", F.timestamp_seconds("s"))
    queue = M.MessageQueue(str(tmp_path / "q"), lambda df: F.col("attempt") > F.col("data").cast("int"), attempts=3)
    queue.process(batch, 0)
    queue.drain(spark)
    assert {r.id: r.attempt for r in queue.done(spark).collect()} == {"0": 1, "1": 2, "2": 3}
    assert {r.id for r in queue.dead(spark).collect()} == {"3", "4", "5"}


def test_collapse_policies(spark):
    rows = [("t", "1", None, "a", 1), ("t", "1", None, "b", 2), ("u", "1", None, "c", 1)]
    df = spark.createDataFrame(rows, "type string, id string, data string, message_id string, s int").withColumn("sent_at", F.timestamp_seconds("s"))
    assert {r.message_id for r in M.collapse_pending(df).collect()} == {"b", "c"}
    assert {r.message_id for r in M.collapse_pending(df, "earliest").collect()} == {"a", "c"}
