import pytest
from pyspark.sql import functions as F

from scanloom.operators import filters as Q

SCHEMA = (
    "study_uid string, patient_id string, patient_name struct<Alphabetic:string>, study_date string, "
    "accession string, description string, modalities array<string>"
)
ROWS = [
    ("1.2.1", "7", ("Doe^Jo",), "20240131", "A1", "head", ["CT", "MR"]),
    ("1.2.2", "8", ("Roe^Jane",), "20240101", "A2", "", ["US"]),
    ("1.2.3", None, None, None, None, None, None),
    ("1.2.4", "7", ("Doe",), "20231231", "", "chest", []),
]


@pytest.fixture(scope="module")
def studies(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def found(df):
    return sorted(r.study_uid for r in df.select("study_uid").collect())


@pytest.mark.parametrize(
    "params, expected",
    [
        ({}, ["1.2.1", "1.2.2", "1.2.3", "1.2.4"]),
        ({"PatientName": "*oe*"}, ["1.2.1", "1.2.2", "1.2.3", "1.2.4"]),
        ({"PatientName": "Doe*"}, ["1.2.1", "1.2.3", "1.2.4"]),
        ({"PatientName": "*Jo"}, ["1.2.1", "1.2.3"]),
        ({"patientid": "7"}, ["1.2.1", "1.2.3", "1.2.4"]),
        ({"00100020": "7"}, ["1.2.1", "1.2.3", "1.2.4"]),
        ({"StudyDate": "20240101-20240131"}, ["1.2.1", "1.2.2", "1.2.3"]),
        ({"StudyDate": "-20240101"}, ["1.2.2", "1.2.3", "1.2.4"]),
        ({"StudyDate": "20240115-"}, ["1.2.1", "1.2.3"]),
        ({"StudyDate": "20240131"}, ["1.2.1", "1.2.3"]),
        ({"ModalitiesInStudy": ["CT", "MR"]}, ["1.2.1", "1.2.3"]),
        ({"StudyDescription": ""}, ["1.2.1", "1.2.2", "1.2.3", "1.2.4"]),
        ({"StudyDescription": "head"}, ["1.2.1", "1.2.2", "1.2.3"]),
        ({"AccessionNumber": "*"}, ["1.2.1", "1.2.2", "1.2.3", "1.2.4"]),
        ({"ReferringPhysicianName": "X"}, ["1.2.1", "1.2.2", "1.2.3", "1.2.4"]),
        ({"PatientID": "7", "StudyDate": "2024*"}, ["1.2.1", "1.2.3"]),
    ],
)
def test_query_parameters(studies, params, expected):
    assert found(Q.qido_filter(studies, params)) == expected


def test_unknown_parameter(studies):
    with pytest.raises(ValueError):
        Q.qido_filter(studies, {"NoSuchThing": "1"})
    assert len(found(Q.qido_filter(studies, {"NoSuchThing": "1"}, compat=True))) == 4


@pytest.mark.parametrize(
    "pattern, text, standard, compat",
    [
        ("Do*", "xDoe", False, True),
        ("*oe", "Doe", True, True),
        ("*oe", "oexoe", True, False),
        ("*abc", "zz", False, True),
        ("*abc", "zzz", False, False),
        ("*a*", "bab", True, True),
        ("x", "", True, True),
        ("x", "y", False, False),
    ],
)
def test_wildcards(spark, pattern, text, standard, compat):
    row = spark.range(1).select(F.lit(text).alias("t")).select(
        Q.match_text(F.col("t"), pattern).alias("s"), Q.match_text(F.col("t"), pattern, True).alias("c")
    ).first()
    assert (row.s, row.c) == (standard, compat)


def test_numbers_compare_by_value(spark):
    df = spark.createDataFrame([("a", 7), ("b", 8)], "study_uid string, accession int")
    assert found(Q.qido_filter(df, {"AccessionNumber": "7"})) == ["a"]
    assert found(Q.qido_filter(df, {"AccessionNumber": ["8", "x"]})) == ["b"]
    assert found(Q.qido_filter(df, {"AccessionNumber": "*"})) == ["a", "b"]


def test_single_uid(studies):
    assert Q.single_uid({"0020000d": "1.2.2"}) == "1.2.2"
    assert Q.single_uid({"STUDYINSTANCEUID": "1.2.2"}) == "1.2.2"
    assert found(Q.single_uid_lookup(studies, {"StudyInstanceUID": "1.2.2"})) == ["1.2.2"]
    assert len(found(Q.single_uid_lookup(studies, {"PatientID": "7"}))) == 4


def test_predicates_reach_the_scan(spark, studies, tmp_path):
    path = str(tmp_path / "index")
    studies.write.parquet(path)
    stored = spark.read.parquet(path)
    required = ["patient_id", "study_date"]
    df = Q.qido_filter(stored, {"PatientID": "7", "StudyDate": "20240101-20240131"}, required=required)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan
    assert "GreaterThanOrEqual(study_date,20240101)" in plan
    assert "BatchEvalPython" not in plan
