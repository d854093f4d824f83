"""What moves between tasks: datasets as text, hashes as bytes, and nothing that lies in its bucket already."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from scanloom.functions import tags as G
from scanloom.operators import dedup as D
from scanloom.operators import stored as S

KEYS = ["study_uid", "series_uid", "sop_uid"]


@pytest.fixture
def full(spark):
    rows = [(f"st{i % 7}", f"se{i % 5}", f"i{i}", f"P{i % 4}\\\"=", "CT" if i % 2 else "MR") for i in range(60)]
    df = spark.createDataFrame(rows, "study_uid string, series_uid string, sop_uid string, patient string, modality string")
    ds = G.dataset({"SOPInstanceUID": F.col("sop_uid"), "PatientID": F.col("patient"), "Modality": F.col("modality"), "SeriesInstanceUID": F.col("series_uid")})
    return df.select(*KEYS, ds.alias("ds"))


@contextmanager
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def texts(df):
    return {r.sop_uid: r.t for r in df.select("sop_uid", G.canonical_text(F.col("ds")).alias("t")).collect()}


def test_stored_recombination_moves_no_row(spark, full):
    split = D.split_extracts(full)
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    for store in (S.write_store(split, 4), S.staged_store(split, 4)):
        with no_broadcast(spark):
            with S.joined_in_place(spark):
                assert exchanges(S.matched(store, KEYS)) == 0
            back = S.recombine_stored(store, KEYS)
        assert texts(back) == texts(full)
    assert spark.conf.get(name, "true") == (before or "true")


def test_the_store_is_staged_as_text_and_bytes(spark, full, monkeypatch):
    moved = []
    write = S.write_bucketed

    def seen(rows, path, buckets, placed=False, **then):
        if not placed:
            moved.append(dict(rows.dtypes))
        return write(rows, path, buckets, placed, **then)

    monkeypatch.setattr(S, "write_bucketed", seen)
    S.write_store(D.split_extracts(full), 4)
    assert len(moved) == 1 and moved[0]["ds"] == "string" and moved[0]["_patient"] == "struct<hash:binary,ds:string>"


def test_recombination_moves_texts_and_short_hashes(spark, full):
    extracts, refs = D.deduplicate(full)
    back = D.recombine(refs, extracts, KEYS)
    # The extracts' own grouping writes text once; the pieces of both sides do so too.
    assert back._jdf.queryExecution().optimizedPlan().toString().lower().count("tojson") >= 3
    assert texts(back) == texts(full)
    # Texts that are no digests stay apart, also from the bytes of others.
    odd = ["6162", "ab", "AB", "6162x", "", "616", None]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").orderBy("i").select(D.short(F.col("t")).alias("s")).collect()]
    assert len({bytes(s) for s in got if s is not None}) == 6 and got[-1] is None


def test_long_chains_move_only_what_is_sent(spark, monkeypatch):
    monkeypatch.setattr(D, "MERGED_ROUNDS", 3)
    n = 9
    files = spark.createDataFrame([("s", f"f{i}", i) for i in range(n)] + [("t", "one", None)], "study_uid string, file_hash string, mtime bigint")
    refs = spark.createDataFrame([("s", f"f{i + 1}", f"f{i}") for i in range(n - 1)], "study_uid string, file_hash string, ref string")
    with no_broadcast(spark):
        out = D.newest_superseders(files, refs)
        assert exchanges(out) == 1
        rows = out.collect()
    got = {(r.study_uid, r.file_hash): (r.by, r.superseded) for r in rows}
    assert len(rows) == n + 1 and got == {("s", f"f{i}"): (f"f{n - 1}", i < n - 1) for i in range(n)} | {("t", "one"): ("one", False)}
