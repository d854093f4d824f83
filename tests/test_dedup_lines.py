"""De-duplication writes a dataset's canonical lines once and hashes its parts from them."""

from pyspark.sql import functions as F

from scanloom.functions import tags as G
from scanloom.operators import dedup as D


def rows(spark):
    table = spark.createDataFrame(
        [(1, "a=b", "1.2", "x\\y"), (2, None, "1.2", "l1\nl2"), (3, "a=b", None, None), (4, None, None, None)], "id int, patient string, series string, own string"
    )
    ds = G.dataset({"PatientName": F.col("patient"), "SeriesInstanceUID": F.col("series"), "SOPInstanceUID": F.col("own"), "Rows": F.col("id").cast("string")})
    return table.select("id", F.when(F.col("id") != 4, ds).alias("ds"))


def test_references_are_those_of_the_split(spark):
    split = D.split_extracts(rows(spark))
    one = D.references_of(split).select("id", "ds", "refs", "type", "hash")
    other = D.deduplicate(rows(spark))[1].select("id", "ds", "refs", "type", "hash")
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    # Hashes are those of the parts themselves, absent and NULL datasets included.
    again = split.select(F.transform("parts", lambda p: p["hash"].eqNullSafe(G.content_hash(p["ds"]))).alias("same"), "ds")
    assert all(all(r.same) for r in again.collect())


def test_references_do_not_build_shared_parts(spark):
    plan = D.deduplicate(rows(spark))[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_filter") == 1
    assert plan.count("sort_array") == 1


def test_distinct_extracts_travel_as_bytes(spark):
    inst = D.deduplicate(rows(spark))[1].withColumn("study_uid", F.lit("1"))
    stats = D.dedup_stats(D.extracts_used(inst), inst)
    assert "unhex" in stats._jdf.queryExecution().optimizedPlan().toString()
    (row,) = stats.select("n_instances", "n_patient", "n_image").collect()
    refs = [r.refs for r in inst.collect()]
    assert tuple(row) == (4, len({r[0] for r in refs}), len({r[3] for r in refs}))
