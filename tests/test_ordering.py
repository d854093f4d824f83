import random

import pytest
from pyspark.sql import functions as F

from scanloom.operators import hierarchy as H
from scanloom.operators import ordering as O
from scanloom.operators import sync as S


def skewed(n=3000, seed=1):
    rnd = random.Random(seed)
    keys = ["hot"] * (n // 3) + [f"k{rnd.randrange(200)}" for _ in range(n - n // 3)]
    rnd.shuffle(keys)
    return [(k, rnd.randrange(50), i) for i, k in enumerate(keys)]


@pytest.mark.parametrize("slices", [1, 7])
def test_ordinal_in_skewed_groups(spark, slices):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = {r.i: r.pos for r in O.with_ordinal(df, ["k"], [F.col("v"), F.col("i")], "pos", slices).collect()}
    want, seen = {}, {}
    for k, v, i in sorted(rows):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert got == want


def test_ordinal_of_whole_table_and_null_keys(spark):
    rows = [(None, i) for i in range(40)] + [("a", i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i int")
    per_key = O.with_ordinal(df, ["k"], [F.col("i")], "pos", 5).collect()
    assert all(r.pos == r.i + 1 for r in per_key)
    whole = O.with_ordinal(df, [], [F.col("k"), F.col("i")], "pos", 5).collect()
    assert sorted(r.pos for r in whole) == list(range(1, 81))


def test_hot_group_is_spread(spark):
    df = spark.createDataFrame(skewed(9000), "k string, v int, i int")
    placed = O.sliced(df, ["k"], [F.col("v"), F.col("i")], 6)
    sizes = [r["count"] for r in placed.groupBy("_slice").count().collect()]
    assert len(sizes) >= 5 and max(sizes) < 9000 / 3


def test_latest_and_first(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), ("b", 2, "w")], "k string, v int, t string")
    assert {r.k: r.t for r in O.latest_per_key(df, ["k"], [F.col("v")]).collect()} == {"a": "y", "b": "w"}
    assert {r.k: r.t for r in O.first_per_key(df, ["k"], [F.col("v")]).collect()} == {"a": "z", "b": "w"}
    plan = O.latest_per_key(df, ["k"], [F.col("v")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_compare_key(spark):
    values = [None, "10", "9", "-1", "", "b", "a", "B", "1e1"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.v for r in df.orderBy(O.compare_key(F.col("v"))).collect()]
    assert got[0] is None and got[1:3] == ["-1", "9"] and set(got[3:5]) == {"10", "1e1"}
    assert got[5:] == ["", "a", "b", "B"]
    compat = [r.v for r in df.orderBy(O.compare_key(F.col("v"), compat=True)).collect()]
    assert compat[:3] == [None, "-1", ""]


def test_middle_element(spark):
    df = spark.createDataFrame([("s", i, 5) for i in range(4)] + [("t", 0, None)], "k string, i int, f int")
    got = {r.k: (r.i, r.group_size, r.middle_frame) for r in O.middle_element(df, ["k"], [F.col("i")], "f").collect()}
    assert got == {"s": (2, 4, 3), "t": (0, 1, 1)}


def test_numbers_missing_or_invalid_come_last(spark):
    rows = [("s", "e", "3", "x", None, "CT"), ("s", "e", "1", "2", None, "MR"), ("s", "e", "2", None, None, "US")]
    df = spark.createDataFrame(rows, "study_uid string, series_uid string, sop_uid string, instance_number string, series_number string, modality string")
    r = H.series_summary(df, ["series_number", "modality"]).first()
    assert (r.modality, r.n_instances) == ("MR", 3)
    order = {x.sop_uid: x.position for x in H.series_instances(df, []).collect()}
    assert order == {"1": 1, "2": 2, "3": 3}


def test_modalities_in_series_order_without_nulls(spark):
    rows = [("s", "a", 3, "CT", 2), ("s", "b", 1, "MR", 1), ("s", "c", 2, None, 4), ("s", "d", None, "CT", 1), ("s", "e", 5, "", 1)]
    df = spark.createDataFrame(rows, "study_uid string, series_uid string, series_number int, modality string, n_instances bigint")
    r = H.study_summary(df, ["series_uid"]).first()
    assert (r.n_series, r.n_instances, r.modalities, r.series_uid) == (5, 9, ["MR", "CT"], "b")


def greedy(rows, limit):
    out, fill, number, last = {}, 0, -1, None
    for bucket, i, size in sorted(rows):
        if bucket != last:
            number, fill, last, is_open = -1, 0, bucket, False
        if not is_open or fill + size > limit:
            number, fill, is_open = number + 1, 0, True
        fill += size
        out[i] = number
    return out


@pytest.mark.parametrize("seed, slices", [(1, 1), (2, 5), (3, 9), (4, 16)])
def test_pack_groups_equals_one_sequential_pass(spark, seed, slices):
    rnd = random.Random(seed)
    sizes = {1: lambda: rnd.randrange(60), 2: lambda: 7, 3: lambda: rnd.choice([0, 0, 5, 100, 101, 250]), 4: lambda: rnd.choice([1, 30, 50])}[seed]
    rows = [("hot" if rnd.random() < 0.5 else f"b{rnd.randrange(4)}", i, sizes()) for i in range(800)]
    df = spark.createDataFrame(rows, "bucket string, i bigint, size bigint")
    got = {r.i: r.group_no for r in S.pack_groups(df, "bucket", ["i"], "size", limit=100, slices=slices).collect()}
    assert got == greedy(rows, 100)
