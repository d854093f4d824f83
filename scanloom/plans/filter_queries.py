"""Queries of the attribute filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import paths as P
from scanloom.functions import values as X
from scanloom.model import TAGS
from scanloom.operators import filters as Q
from scanloom.operators import hierarchy as H
from scanloom.plans import view as V
from scanloom.plans.registry import query, table
from scanloom.session import new_folder
from scanloom.sources import sinks as K


def pick(df):
    return df.select("study_uid", "patient_name", "study_date", "description")


@query("qido_filter", f"""
WITH {V.SQL_STUDIES}
SELECT study_uid, patient_name, study_date, description FROM studies
WHERE contains(patient_name, '01') AND study_date >= '19960101' AND study_date <= '19981231'
  AND description IN ('BUILDING', 'MACHINERY') AND accession <> '2-HIGH'""")
def qido_filter(spark, folder):
    params = {
        "patientname": "*01*",
        "00080020": "19960101-19981231",
        "StudyDescription": ["BUILDING", "MACHINERY"],
    }
    required = ["patient_name", "study_date", "description"]
    # An attribute of the site's own dictionary.
    site = {**TAGS, "AdmissionID": ("00380010", "LO")}
    params["admissionid"] = ["1-URGENT", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    columns = {**Q.STUDY_COLUMNS, "AdmissionID": "accession"}
    return pick(Q.qido_filter(V.studies(spark, folder), params, columns, required, dictionary=site))


@query("match_exact", """
SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'""")
def match_exact(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return c.where(Q.match_text(F.col("c_mktsegment"), "BUILDING"))


PATTERNS = ["*ring*", "small*", "*bolt", "*small rings", "red widget", "*"]


@query("match_wildcard", """
SELECT p_partkey, contains(p_name, 'ring') AS m0, starts_with(p_name, 'small') AS m1,
       suffix(p_name, 'bolt') AS m2, suffix(p_name, 'small rings') AS m3,
       p_name = 'red widget' AS m4, true AS m5 FROM part""")
def match_wildcard(spark, folder):
    part = table(spark, folder, "part")
    return part.select(
        "p_partkey", *[Q.match_text(F.col("p_name"), p).alias(f"m{i}") for i, p in enumerate(PATTERNS)]
    )


@query("match_wildcard_compat", """
SELECT p_partkey, contains(p_name, 'ring') AS m0, contains(p_name, 'small') AS m1,
       strpos(p_name, 'bolt') - 1 = length(p_name) - 4 AS m2,
       strpos(p_name, 'small rings') - 1 = length(p_name) - 11 AS m3,
       p_name = 'red widget' AS m4, true AS m5 FROM part""")
def match_wildcard_compat(spark, folder):
    part = table(spark, folder, "part")
    return part.select(
        "p_partkey",
        *[Q.match_text(F.col("p_name"), p, compat=True).alias(f"m{i}") for i, p in enumerate(PATTERNS)],
    )


@query("match_list", f"""
WITH {V.SQL_INSTANCES},{V.SQL_SERIES},{V.SQL_STUDY_ROWS}
SELECT study_uid, n_series, modalities FROM study_rows
WHERE contains(modalities, 'A') OR contains(modalities, 'R')""")
def match_list(spark, folder):
    series = H.series_summary(V.instances(spark, folder), V.INSTANCE_COLUMNS)
    rows = Q.qido_filter(H.study_summary(series), {"ModalitiesInStudy": ["A", "R"]}, required=["modalities"])
    return rows.select("study_uid", "n_series", F.array_join("modalities", ",").alias("modalities"))


@query("match_person_name", """
SELECT c_custkey, c_name FROM customer WHERE suffix(c_name, '7') OR c_name = 'Customer#000000012'""")
def match_person_name(spark, folder):
    people = table(spark, folder, "customer").select(
        "c_custkey", "c_name", F.array(F.struct(F.col("c_name").alias("Alphabetic"))).alias("patient_name")
    )
    found = Q.qido_filter(people, {"PatientName": ["*7", "Customer#000000012"]})
    return found.select("c_custkey", "c_name")


@query("match_date_range", """
SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS study_date,
       strftime(o_orderdate, '%Y%m%d') BETWEEN '19970101' AND '19970630' AS closed,
       strftime(o_orderdate, '%Y%m%d') >= '19980101' AS open_end,
       strftime(o_orderdate, '%Y%m%d') <= '19951231' AS open_start,
       strftime(o_orderdate, '%Y%m%d') = '19970303' AS exact FROM orders""")
def match_date_range(spark, folder):
    days = table(spark, folder, "orders").select("o_orderkey", V.yyyymmdd("o_orderdate").alias("study_date"))
    d = F.col("study_date")
    return days.select(
        "*",
        Q.match_date_range(d, "19970101-19970630").alias("closed"),
        Q.match_date_range(d, "19980101-").alias("open_end"),
        Q.match_date_range(d, "-19951231").alias("open_start"),
        Q.match_date_range(d, "19970303").alias("exact"),
    )


@query("missing_matches", """
SELECT c_custkey, max(o_orderpriority) AS accession FROM customer
LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000
GROUP BY c_custkey HAVING max(o_orderpriority) IS NULL OR max(o_orderpriority) = '5-LOW'""")
def missing_matches(spark, folder):
    o = table(spark, folder, "orders").where("o_totalprice > 400000")
    top = o.groupBy("o_custkey").agg(F.max("o_orderpriority").alias("accession"))
    c = table(spark, folder, "customer").select("c_custkey")
    rows = c.join(top, c["c_custkey"] == top["o_custkey"], "left").select("c_custkey", "accession")
    return Q.qido_filter(rows, {"AccessionNumber": "5-LOW", "StudyDescription": ""})


@query("single_uid_lookup", f"""
WITH {V.SQL_INSTANCES} SELECT * FROM instances WHERE study_uid = '1.2.7'""")
def single_uid_lookup(spark, folder):
    """On a stored archive: the bucket prunes folders, the UID row groups."""
    path = new_folder(spark, "archive")
    K.write_archive(V.instances(spark, folder), path, buckets=8)
    return Q.single_uid_lookup(spark.read.parquet(path), {"0020000d": "1.2.7"}, buckets=8).drop("study_bucket")


@query("include_exclude", """
SELECT page_id, url FROM pages WHERE (contains(url, '/en/') OR contains(url, '.org'))
  AND NOT contains(url, 'ref=')""")
def include_exclude(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    return pages.where(P.include_exclude(F.col("url"), ["/en/", ".org"], ["ref="]))


@query("name_list_filter", "SELECT p_partkey, p_type FROM part WHERE p_type IN ('SMALL', 'PROMO')")
def name_list_filter(spark, folder):
    return table(spark, folder, "part").select("p_partkey", "p_type").where(
        P.name_in(F.col("p_type"), ["SMALL", "PROMO"]) & P.name_in(F.col("p_type"), [])
    )


@query("raw_object_selector", f"""
WITH {V.SQL_INSTANCES},
m AS (SELECT sop_uid, CASE modality WHEN 'A' THEN 'SEG' WHEN 'R' THEN 'CT' ELSE 'OT' END AS kind,
             CASE line_status WHEN 'F' THEN '1.2.840.10008.5.1.4.1.1.30' ELSE '1.2.3' END AS sop_class FROM instances)
SELECT * FROM m WHERE kind IN ('SEG', 'SR') OR sop_class = '1.2.840.10008.5.1.4.1.1.30'""")
def raw_object_selector(spark, folder):
    m = V.instances(spark, folder).select(
        "sop_uid",
        F.when(F.col("modality") == "A", "SEG").when(F.col("modality") == "R", "CT").otherwise("OT").alias("kind"),
        F.when(F.col("line_status") == "F", "1.2.840.10008.5.1.4.1.1.30").otherwise("1.2.3").alias("sop_class"),
    )
    return m.where(X.keep_raw(F.col("kind"), F.col("sop_class")))


@query("study_selection", f"""
WITH {V.SQL_INSTANCES},{V.SQL_STUDIES}
SELECT study_uid, sop_uid FROM instances
WHERE study_uid IN (SELECT study_uid FROM studies WHERE accession = '1-URGENT')""")
def study_selection(spark, folder):
    urgent = V.studies(spark, folder).where("accession = '1-URGENT'")
    chosen = Q.select_studies(V.instances(spark, folder), urgent)
    return Q.select_studies(chosen, ["*"]).select("study_uid", "sop_uid")
