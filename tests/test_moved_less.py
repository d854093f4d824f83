"""De-duplication, updates, documents and recombination move less: rows stay where they lie, hashes are taken after a move."""

from pyspark.sql import functions as F

from scanloom.functions import tags as G
from scanloom.operators import dedup as D
from scanloom.operators import stored as S
from scanloom.operators import summaries as U
from scanloom.operators.joins import may_be_among
from scanloom.plans import catalog

KEYS = ["study_uid", "series_uid", "sop_uid"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark, n=40):
    table = spark.range(n).select(
        F.concat(F.lit("1."), (F.col("id") % 5).cast("string")).alias("study_uid"), F.concat(F.lit("1.9."), (F.col("id") % 7).cast("string")).alias("series_uid"),
        F.when(F.col("id") != 3, F.concat(F.lit("1.8."), F.col("id").cast("string"))).alias("sop_uid"),
    )
    ds = G.dataset({"PatientName": F.when(F.col("study_uid") != "1.2", F.concat(F.lit("a=\n"), "study_uid")), "StudyInstanceUID": F.col("study_uid"), "SeriesInstanceUID": F.col("series_uid"), "SOPInstanceUID": F.col("sop_uid")})
    return table.select(*KEYS, F.when(F.coalesce("sop_uid", F.lit("")) != "1.8.4", ds).alias("ds"))


def test_hashes_do_not_travel_with_extracts(spark):
    one, _ = D.deduplicate(rows(spark))
    other = D.extracts_of(D.split_extracts(rows(spark)))
    assert sorted(map(str, one.collect())) == sorted(map(str, other.select(one.columns).collect()))
    assert "unhex" not in plan_of(one)  # the hash is no key of the groups


def test_filter_of_hashes(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("key")).union(spark.range(1).select(F.lit(None).cast("long")))
    test = may_be_among(keys)
    found = spark.range(20_000).where(test(F.xxhash64("id")))
    assert found.where("id < 1000").count() == 1000 and found.count() < 3500
    none = may_be_among(keys.where("key is null"))
    assert spark.range(50).where(none(F.col("id"))).count() == 0


def test_instances_without_replaced_references_are_not_moved(spark):
    inst = spark.createDataFrame(
        [(1, "a", ["x", "y"]), (2, "b", ["z"]), (3, "c", None), (4, "d", []), (None, "e", ["x"]), (5, "f", ["y", "y2"])], "k long, l string, refs array<string>"
    )
    swaps = spark.createDataFrame([("x", "x9", 1), ("x", "x1", 2), ("y", None, 3), ("y2", "y3", 1)], "old_hash string, new_hash string, at int")
    out = D.update_attributes(inst, swaps, ["k", "l"])
    assert "Union" in plan_of(out)
    assert {(r.k, r.l): r.refs for r in out.collect()} == {(1, "a"): ["x1", "y"], (2, "b"): ["z"], (3, "c"): None, (4, "d"): [], (None, "e"): ["x"], (5, "f"): ["y", "y3"]}


def test_counts_per_study_stay_in_their_buckets(spark, sf):
    assert "Exchange hashpartitioning" not in plan_of(catalog.QUERIES["dedup_stats"](spark, sf))


def test_documents_are_made_inside_buckets(spark, sf, monkeypatch):
    plans = []
    monkeypatch.setattr(U, "write_documents", lambda docs, path, f=U.write_documents: (plans.append(plan_of(docs)), f(docs, path))[1])
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true")
    assert catalog.QUERIES["archive_documents"](spark, sf).count() > 0
    assert "Exchange hashpartitioning" not in plans[0]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true") == before


def test_recombination_joins_type_by_type(spark):
    split = D.split_extracts(rows(spark).where("sop_uid IS NOT NULL AND ds IS NOT NULL"))
    inst, extracts = D.references_of(split), D.extracts_of(split)
    odd = inst.where("sop_uid = '1.8.7'").withColumn("refs", F.concat("refs", F.array(F.lit("more")))).unionByName(inst.where("sop_uid = '1.8.8'").withColumn("refs", F.lit(None).cast("array<string>")))
    inst = inst.where("sop_uid NOT IN ('1.8.7', '1.8.8')").unionByName(odd)
    back = D.recombine(inst, extracts.where("type <> 'series'"), KEYS)
    assert "Join" not in plan_of(back)  # what was found of a type is written
    missing = {r.sop_uid: r.missing_refs for r in back.collect()}
    assert missing.pop("1.8.7") == 2 and missing.pop("1.8.8") == 0 and set(missing.values()) == {1}


def test_rows_are_split_where_they_lie(spark):
    full = rows(spark).where("ds IS NOT NULL")
    hot = full.groupBy("study_uid").agg(F.lit(2).alias("slices"))
    split = D.split_extracts(S.by_cell(full, 4, hot))
    assert plan_of(split).index("sha2") < plan_of(split).index("Exchange")  # upper nodes come first
    one, other = S.write_store(split, 4, placed=True), S.write_store(D.split_extracts(full), 4, hot)
    for a, b in ((one.refs, other.refs), (one.extracts, other.extracts)):
        assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))
