"""Queries of tag access, normalisation and value expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import paths as P
from scanloom.functions import tags as G
from scanloom.functions import values as X
from scanloom.model import PATIENT_QUERY, TAGS
from scanloom.operators import attributes as A
from scanloom.plans import view as V
from scanloom.plans.registry import query, table


def header(spark, folder):
    """Patient and study header of every order as a dataset."""
    s = V.studies(spark, folder)
    return s.select(
        "study_uid",
        G.dataset({
            "StudyInstanceUID": F.col("study_uid"),
            "StudyDate": F.col("study_date"),
            "AccessionNumber": F.col("accession"),
            "PatientID": F.col("patient_id"),
            "PatientName": F.to_json(F.struct(F.col("patient_name").alias("Alphabetic"))),
            "StudyDescription": F.when(F.col("study_status") != "P", F.col("description")),
        }).alias("ds"),
    )


@query("tag_get_value", f"""
WITH {V.SQL_STUDIES}
SELECT study_uid, patient_id, '{{"Alphabetic":"' || patient_name || '"}}' AS name, patient_name AS alphabetic,
       CASE WHEN study_status <> 'P' THEN description END AS description,
       study_date || '\\' || accession AS several, '' AS none FROM studies""")
def tag_get_value(spark, folder):
    ds = F.col("ds")
    several = G.set_value(
        ds, "ImageType", F.array(G.get_value(ds, "StudyDate"), G.get_value(ds, "AccessionNumber"))
    )
    name = F.parse_json(G.get_value(ds, "PatientName"))
    return header(spark, folder).select(
        "study_uid",
        G.get_value(ds, "PatientID").alias("patient_id"),
        G.get_value(ds, "00100010").alias("name"),
        F.try_variant_get(name, "$.Alphabetic", "string").alias("alphabetic"),
        G.get_value(ds, "StudyDescription").alias("description"),
        G.get_value(several, "ImageType").alias("several"),
        G.get_value(G.set_value(ds, "StudyID", F.array()), "StudyID").alias("none"),
    )


@query("tag_get_list", f"""
WITH {V.SQL_STUDIES}
SELECT study_uid, 1 AS n_accession, CASE WHEN study_status <> 'P' THEN 1 ELSE 0 END AS n_description, accession
FROM studies""")
def tag_get_list(spark, folder):
    empty = F.array().cast("array<string>")
    values = G.get_list(F.col("ds"), "AccessionNumber")
    return header(spark, folder).select(
        "study_uid",
        F.size(values).alias("n_accession"),
        F.size(F.coalesce(G.get_list(F.col("ds"), "StudyDescription"), empty)).alias("n_description"),
        F.array_join(values, ",").alias("accession"),
    )


# A site's dictionary: two attributes more than the built-in ones.
SITE = {**TAGS, "PatientSize": ("00101020", "DS"), "AdmissionDate": ("00380020", "DA")}


@query("tag_set_value", f"""
WITH {V.SQL_STUDIES}
SELECT study_uid, 'SH' AS vr, study_date || '-' || patient_id AS accession, 'UN' AS private_vr, 'DS' AS site_vr,
       CASE WHEN study_status <> 'P' THEN 8 ELSE 7 END AS n_tags FROM studies""")
def tag_set_value(spark, folder):
    ds = F.col("ds")
    stamp = F.concat_ws("-", G.get_value(ds, "StudyDate"), G.get_value(ds, "PatientID"))
    changed = G.set_value(G.set_value(ds, "AccessionNumber", F.array(stamp)), "00111001", F.array(F.lit("x")))
    changed = G.set_value(changed, "PatientSize", F.array(F.lit("1.7")), dictionary=SITE)
    return header(spark, folder).select("study_uid", changed.alias("ds")).select(
        "study_uid",
        ds["00080050"]["vr"].alias("vr"),
        G.get_value(ds, "AccessionNumber").alias("accession"),
        ds["00111001"]["vr"].alias("private_vr"),
        ds["00101020"]["vr"].alias("site_vr"),
        F.size("ds").alias("n_tags"),
    )


@query("tag_push_list", f"""
WITH {V.SQL_STUDIES}
SELECT study_uid, accession || ',' || patient_id AS pushed, study_date AS created, false AS has_name,
       CASE WHEN study_status <> 'P' THEN 6 ELSE 5 END AS n_tags FROM studies""")
def tag_push_list(spark, folder):
    ds = F.col("ds")
    pushed = G.push_list(ds, "AccessionNumber", G.get_value(ds, "PatientID"))
    pushed = G.push_list(pushed, "ContentDate", G.get_value(ds, "StudyDate"))
    out = G.remove_value(pushed, "PatientName")
    return header(spark, folder).select("study_uid", out.alias("ds")).select(
        "study_uid",
        F.array_join(G.get_list(ds, "AccessionNumber"), ",").alias("pushed"),
        G.get_value(ds, "ContentDate").alias("created"),
        F.map_contains_key("ds", F.lit("00100010")).alias("has_name"),
        F.size("ds").alias("n_tags"),
    )


BLOCK_SQL = "CASE p_type WHEN 'SMALL' THEN 16 WHEN 'PROMO' THEN 26 WHEN 'LARGE' THEN 63 END"


@query("private_tag_resolve", f"""
WITH b AS (SELECT p_partkey, p_brand, {BLOCK_SQL} AS block FROM part)
SELECT p_partkey, '0009' || printf('%02X', block) || '05' AS found,
       CASE WHEN block IS NULL THEN '00091005' ELSE '0009' || printf('%02X', block) || '05' END AS target,
       p_brand AS value FROM b""")
def private_tag_resolve(spark, folder):
    """Parts with a private block at 10, 1A or 3F, or none at all."""
    part = table(spark, folder, "part")
    block = F.expr(BLOCK_SQL)
    holder = F.when(
        block.isNotNull(),
        F.create_map(F.concat(F.lit("000900"), F.hex(block)), G.attribute("LO", F.array(F.lit("ACME")))),
    ).otherwise(F.map_filter(F.create_map(F.lit("x"), G.attribute("LO", F.array(F.lit("")))), lambda k, v: F.lit(False)))
    rows = part.select("p_partkey", "p_brand", holder.alias("ds"))
    ds = F.col("ds")
    written = G.put_private(ds, "00091005", "ACME", "LO", F.array("p_brand"))
    return rows.select("*", written.alias("new")).select(
        "p_partkey",
        G.private_tag(ds, "00091005", "ACME").alias("found"),
        G.reserve_private_block(ds, "00091005", "ACME").alias("target"),
        F.get(F.col("new")[G.private_tag(F.col("new"), "00091005", "ACME")]["Value"], F.lit(0)).alias("value"),
    )


TAG_SQL = "printf('%04X', p_size + 8) || printf('%04X', p_partkey % 65536)"


def part_tags(spark, folder):
    group = F.lpad(F.hex(F.col("p_size") + 8), 4, "0")
    element = F.lpad(F.hex(F.col("p_partkey") % 65536), 4, "0")
    return table(spark, folder, "part").withColumn("tag", F.concat(group, element))


@query("is_private_tag", f"SELECT p_partkey, {TAG_SQL} AS tag, (p_size + 8) % 2 = 1 AS private FROM part")
def is_private_tag(spark, folder):
    return part_tags(spark, folder).select("p_partkey", "tag", G.is_private(F.col("tag")).alias("private"))


@query("vr_lookup", """
SELECT p_partkey, tag, CASE WHEN p_brand = 'Brand#1' THEN 'CS' WHEN tag = '00080060' THEN 'CS'
  WHEN tag = '00100010' THEN 'PN' WHEN tag = '00281050' THEN 'DS' ELSE 'UN' END AS vr
FROM (SELECT p_partkey, p_brand, CASE p_type WHEN 'SMALL' THEN '00080060' WHEN 'PROMO' THEN '00100010'
        WHEN 'LARGE' THEN '00281050' ELSE '00191234' END AS tag FROM part)""")
def vr_lookup(spark, folder):
    part = table(spark, folder, "part")
    code = (
        F.when(F.col("p_type") == "SMALL", "00080060").when(F.col("p_type") == "PROMO", "00100010")
        .when(F.col("p_type") == "LARGE", "00281050").otherwise("00191234")
    )
    rows = part.select("p_partkey", code.alias("tag"), F.when(F.col("p_brand") == "Brand#1", "CS").alias("vr"))
    return G.with_vr(rows)


@query("naturalize", f"""
WITH {V.SQL_STUDIES}
SELECT study_uid, CASE WHEN study_status <> 'P' THEN
  'AccessionNumber,PatientID,PatientName,PatientSize,StudyDate,StudyDescription,StudyInstanceUID'
  ELSE 'AccessionNumber,PatientID,PatientName,PatientSize,StudyDate,StudyInstanceUID' END AS keywords,
  true AS restored, accession FROM studies""")
def naturalize(spark, folder):
    natural = G.naturalize(F.col("ds"), SITE)
    sized = G.set_value(F.col("ds"), "00101020", F.array(F.lit("1.7")), dictionary=SITE)
    return header(spark, folder).select("study_uid", sized.alias("ds")).select("study_uid", "ds", natural.alias("n")).select(
        "study_uid",
        F.array_join(F.array_sort(F.map_keys("n")), ",").alias("keywords"),
        (F.array_sort(F.map_entries(G.denaturalize(F.col("n"), SITE))) == F.array_sort(F.map_entries("ds"))).alias("restored"),
        F.get(F.col("n")["AccessionNumber"]["Value"], F.lit(0)).alias("accession"),
    )


@query("typed_values", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice,
       CAST(l_quantity + l_discount AS DECIMAL(18, 2)) AS decimal_sum, 2 AS n_decimals,
       l_partkey + l_suppkey AS integer_sum, l_returnflag || ',' || l_linestatus AS names,
       l_returnflag || '\\' || l_linestatus AS one_text, 0 AS n_blank FROM lineitem""")
def typed_values(spark, folder):
    li = table(spark, folder, "lineitem")
    ds = G.typed_values(F.lit("DS"), F.concat_ws("\\", F.col("l_quantity"), F.col("l_discount")))["decimals"]
    is_ = G.typed_values(F.lit("IS"), F.concat_ws("\\", F.col("l_partkey"), F.col("l_suppkey")))["integers"]
    flags = F.concat_ws("\\", F.col("l_returnflag"), F.col("l_linestatus"))
    names = G.typed_values(F.lit("PN"), flags)["names"]
    texts = G.typed_values(F.lit("CS"), flags)["texts"]
    total = F.aggregate(is_, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return li.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice",
        F.aggregate(ds, F.lit(0.0), lambda a, x: a + x).cast("decimal(18,2)").alias("decimal_sum"),
        F.size(ds).alias("n_decimals"),
        total.alias("integer_sum"),
        F.array_join(F.transform(names, lambda n: n["Alphabetic"]), ",").alias("names"),
        F.get(texts, F.lit(0)).alias("one_text"),
        F.size(G.typed_values(F.lit("LO"), F.lit(""))["texts"]).alias("n_blank"),
    )


@query("canonicalize", """
SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN p_name WHEN 'PROMO' THEN p_name || ',' || p_brand
  WHEN 'LARGE' THEN '' ELSE CAST(p_size AS VARCHAR) END AS joined,
  CASE p_type WHEN 'PROMO' THEN 2 WHEN 'LARGE' THEN 0 ELSE 1 END AS n FROM part""")
def canonicalize(spark, folder):
    part = table(spark, folder, "part")
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    doc = (
        F.when(F.col("p_type") == "SMALL", quoted("p_name"))
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("["), quoted("p_name"), F.lit(","), quoted("p_brand"), F.lit("]")))
        .when(F.col("p_type") == "LARGE", "[]")
        .otherwise(F.col("p_size").cast("string"))
    )
    values = G.canonical_values(F.parse_json(doc))
    texts = F.transform(values, lambda v: F.try_variant_get(v, "$", "string"))
    return part.select("p_partkey", texts.alias("t")).select(
        "p_partkey", F.array_join("t", ",").alias("joined"), F.size("t").alias("n")
    )


@query("extract_tagset", f"""
WITH {V.SQL_STUDIES}
SELECT study_uid, '00100010,00100020' AS patient_tags, CASE WHEN study_status <> 'P' THEN 4 ELSE 3 END AS rest,
       patient_name FROM studies""")
def extract_tagset(spark, folder):
    ds = F.col("ds")
    patient = G.project(ds, PATIENT_QUERY)
    return header(spark, folder).select(
        "study_uid",
        F.array_join(F.array_sort(F.map_keys(patient)), ",").alias("patient_tags"),
        F.size(G.without(ds, PATIENT_QUERY)).alias("rest"),
        F.get_json_object(G.get_value(patient, "PatientName"), "$.Alphabetic").alias("patient_name"),
    )


@query("content_hash", """
SELECT p_partkey, sha256('00081030=R:LO=V1:+' || replace(p_name, '=', '\\=') || chr(10)
  || '00081090=R:LO=V1:+' || p_brand || chr(10) || '00200011=R:IS=V1:+' || p_size) AS hash, true AS order_free, 9 AS n_different FROM part""")
def content_hash(spark, folder):
    part = table(spark, folder, "part")
    size = F.col("p_size").cast("string")
    one = G.dataset({"SeriesNumber": size, "StudyDescription": F.col("p_name"), "ManufacturerModelName": F.col("p_brand")})
    two = G.dataset({"ManufacturerModelName": F.col("p_brand"), "StudyDescription": F.col("p_name"), "SeriesNumber": size})
    # Datasets that a careless text makes equal.
    brand, none, empty = F.col("p_brand"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    texts = lambda *x: F.array(*x).cast("array<string>")
    shapes = [
        (texts(brand), none, none), (empty, brand, none), (empty, none, brand), (texts(none, brand), none, none), (texts(brand, none), none, none),
        (texts(), none, none), (texts(F.lit("")), none, none), (empty, none, none), (texts(F.concat(brand, F.lit("\\+"), brand)), none, none),
    ]
    hashes = [
        G.content_hash(F.create_map(F.lit("00281199"), F.struct(
            F.lit("OW").alias("vr"), v.alias("Value"), i.alias("InlineBinary"), b.alias("BulkDataURI")
        ))) for v, i, b in shapes
    ]
    return part.select("p_partkey", G.content_hash(one).alias("hash"), G.content_hash(two).alias("h2"), F.array(*hashes).alias("h")).select(
        "p_partkey", "hash", (F.col("hash") == F.col("h2")).alias("order_free"), F.size(F.array_distinct("h")).alias("n_different")
    )


@query("rewrite_bulk_uri", """
WITH u AS (SELECT doc_id, CASE lang WHEN 'en' THEN './frames' WHEN 'fr' THEN './frames/1'
  ELSE '../../../../bulkdata/' || source || '/x.mht' END AS uri FROM documents)
SELECT doc_id, CASE WHEN starts_with(uri, './frames') THEN './instances/1.2.' || doc_id || '/frames'
  ELSE '../../' || substr(uri, 13) END AS uri,
  '{"a":{"BulkDataURI":"' || CASE WHEN starts_with(uri, './frames') THEN './instances/1.2.' || doc_id || '/frames'
  ELSE '../../' || substr(uri, 13) END || '"}}' AS doc FROM u""")
def rewrite_bulk_uri(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "lang", "source")
    uri = (
        F.when(F.col("lang") == "en", "./frames").when(F.col("lang") == "fr", "./frames/1")
        .otherwise(F.concat(F.lit("../../../../bulkdata/"), F.col("source"), F.lit("/x.mht")))
    )
    sop = F.concat(F.lit("1.2."), F.col("doc_id").cast("string"))
    doc = F.concat(F.lit('{"a":{"BulkDataURI":"'), uri, F.lit('"}}'))
    return d.select("doc_id", P.rewrite_bulk_uri(uri, sop).alias("uri"), P.rewrite_bulk_uris(doc, sop).alias("doc"))


@query("expand_uri", f"""
WITH {V.SQL_INSTANCES}
SELECT sop_uid, 'https://host/' || 'studies/' || study_uid || '/series/' || series_uid || '/bulkdata/' || part_key AS full_uri,
       'https://host/studies/' || study_uid || '/bulkdata/' || part_key AS study_uri,
       'https://host/bulkdata/' || part_key AS plain_uri FROM instances""")
def expand_uri(spark, folder):
    path = F.concat(F.lit("bulkdata/"), F.col("part_key").cast("string"))
    study, series = F.col("study_uid"), F.col("series_uid")
    host = "https://host/"
    return V.instances(spark, folder).select(
        "sop_uid",
        P.expand_uri(path, study, series, host, include_series=True).alias("full_uri"),
        P.expand_uri(path, study, series, host).alias("study_uri"),
        P.expand_uri(path, study, series, host, expand=False).alias("plain_uri"),
    )


@query("retrieve_url", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'https://host' WHEN 'F' THEN 'https://host/x' ELSE '' END
  || '/api/studies/1.2.' || o_orderkey AS url, 'h/studies/1.2.' || o_orderkey AS relative FROM orders""")
def retrieve_url(spark, folder):
    root = (
        F.when(F.col("o_orderstatus") == "O", "https://host//").when(F.col("o_orderstatus") == "F", "https://host/x")
        .otherwise("")
    )
    uid = F.concat(F.lit("1.2."), F.col("o_orderkey").cast("string"))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        P.retrieve_url(uid, root).alias("url"),
        P.retrieve_url(uid, F.lit("h/"), "studies/{studyInstanceUID}").alias("relative"),
    )


@query("join_uri", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+') AS host,
                  regexp_replace(url, '^https?://[^/]+', '') AS path FROM pages)
SELECT page_id, host || path AS absolute,
       host || '/' || substr(path, 2) AS relative, 'root' || path AS rooted, host AS alone FROM p""")
def join_uri(spark, folder):
    host = F.regexp_extract("url", "^https?://[^/]+", 0)
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    return table(spark, folder, "pages").select("page_id", host.alias("h"), path.alias("p")).select(
        "page_id",
        P.join_uri(F.concat(F.col("h"), F.lit("/")), F.col("p")).alias("absolute"),
        P.join_uri(F.col("h"), F.substr("p", F.lit(2))).alias("relative"),
        P.join_uri(F.lit(""), F.lit("root/"), F.lit(None).cast("string"), F.col("p")).alias("rooted"),
        P.join_uri(F.col("h"), F.lit("")).alias("alone"),
    )


@query("parse_reject_path", f"""
WITH {V.SQL_INSTANCES}
SELECT sop_uid AS id, study_uid, CASE WHEN modality <> 'N' THEN series_uid END AS series_uid,
       CASE WHEN modality = 'A' THEN sop_uid END AS sop_uid
FROM (SELECT sop_uid, CASE WHEN modality <> 'N' THEN study_uid END AS study_uid, modality, series_uid FROM instances)""")
def parse_reject_path(spark, folder):
    study, series, sop = F.col("study_uid"), F.col("series_uid"), F.col("sop_uid")
    path = (
        F.when(F.col("modality") == "A", P.archive_path(study, series, sop))
        .when(F.col("modality") == "R", F.concat_ws("/", study, series))
        .otherwise(F.concat(study, F.lit("/a b")))
    )
    parsed = P.parse_reject_path(path)
    return V.instances(spark, folder).select(F.col("sop_uid").alias("id"), parsed.alias("r")).select("id", "r.*")


@query("parse_frame_list", """
WITH s AS (SELECT p_partkey, p_size, CASE p_type WHEN 'SMALL' THEN '3-' || (p_size + 3) || ',1, 3'
  WHEN 'PROMO' THEN p_size || '-0' WHEN 'LARGE' THEN 'x' WHEN 'STANDARD' THEN p_size || '-2147483647' ELSE '' END AS txt, p_type FROM part)
SELECT p_partkey, txt, CASE WHEN p_type = 'SMALL' THEN '1:1,3:3,3:' || (p_size + 3) WHEN p_type = 'PROMO' AND p_size > 0 THEN NULL
       WHEN p_type = 'PROMO' THEN '0:0' WHEN p_type = 'LARGE' THEN NULL WHEN p_type = 'STANDARD' THEN p_size || ':2147483647' ELSE '1:1' END AS ranges,
  CASE WHEN p_type = 'SMALL' THEN '1,' || array_to_string(range(3, p_size + 4), ',')
       WHEN p_type = 'PROMO' AND p_size > 0 THEN NULL WHEN p_type = 'PROMO' THEN '0'
       WHEN p_type IN ('LARGE', 'STANDARD') THEN NULL ELSE '1' END AS frames,
  (p_type = 'PROMO' AND p_size > 0) OR p_type = 'LARGE' AS invalid FROM s""")
def parse_frame_list(spark, folder):
    part = table(spark, folder, "part")
    size = F.col("p_size")
    text = (
        F.when(F.col("p_type") == "SMALL", F.concat(F.lit("3-"), (size + 3).cast("string"), F.lit(",1, 3")))
        .when(F.col("p_type") == "PROMO", F.concat(size.cast("string"), F.lit("-0")))
        .when(F.col("p_type") == "LARGE", "x")
        .when(F.col("p_type") == "STANDARD", F.concat(size.cast("string"), F.lit("-2147483647"))).otherwise("")
    )
    pairs = F.transform("r.ranges", lambda x: F.concat(x["lo"].cast("string"), F.lit(":"), x["hi"].cast("string")))
    return part.select("p_partkey", text.alias("txt")).select(
        "p_partkey", "txt", X.parse_frame_list(F.col("txt")).alias("r")
    ).select(
        "p_partkey", "txt", F.array_join(pairs, ",").alias("ranges"), F.array_join("r.frames", ",").alias("frames"), F.col("r.error").isNotNull().alias("invalid")
    )


@query("parse_size", """
SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN p_size::BIGINT * 1024 WHEN 'PROMO' THEN CAST(p_size * 1048576 + 524288 AS BIGINT)
  WHEN 'LARGE' THEN p_size::BIGINT * 1073741824 WHEN 'ECONOMY' THEN p_size WHEN 'STANDARD' THEN p_size::BIGINT * 1099511627776 END AS bytes
FROM part""")
def parse_size(spark, folder):
    size = F.col("p_size").cast("string")
    text = (
        F.when(F.col("p_type") == "SMALL", F.concat(size, F.lit(" k")))
        .when(F.col("p_type") == "PROMO", F.concat(size, F.lit(".5MB")))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit(" "), size, F.lit("gb")))
        .when(F.col("p_type") == "ECONOMY", size)
        .when(F.col("p_type") == "STANDARD", F.concat(size, F.lit("T")))
        .otherwise(F.concat(F.lit("x"), size))
    )
    return table(spark, folder, "part").select("p_partkey", X.parse_size(text).alias("bytes"))


@query("parse_duration", """
SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN p_size * 3600000 WHEN 'PROMO' THEN p_size * 60000 + 30000
  WHEN 'LARGE' THEN p_size * 1000 WHEN 'ECONOMY' THEN p_size * 1000 END::BIGINT AS ms FROM part""")
def parse_duration(spark, folder):
    size = F.col("p_size").cast("string")
    text = (
        F.when(F.col("p_type") == "SMALL", F.concat(size, F.lit("H")))
        .when(F.col("p_type") == "PROMO", F.concat(size, F.lit(".5m")))
        .when(F.col("p_type") == "LARGE", F.concat(size, F.lit("s")))
        .when(F.col("p_type") == "ECONOMY", size)
        .otherwise(F.concat(size, F.lit("d")))
    )
    return table(spark, folder, "part").select("p_partkey", X.parse_duration(text).alias("ms"))


@query("externalize_bulk", """
WITH d AS (SELECT doc_id, text, lang = 'en' AS private, CASE WHEN source = 'src3' THEN 0 ELSE strlen(text) END AS bytes,
  sha256(text) AS h FROM documents)
SELECT doc_id, CASE WHEN bytes >= CASE WHEN private THEN 128 ELSE 1000 END
    THEN '../../../../bulkdata/' || h[1:2] || '/' || h[3:4] || '/' || h[5:] || '.mht.gz' END AS uri,
  CASE WHEN bytes < CASE WHEN private THEN 128 ELSE 1000 END THEN to_base64(encode(text)) END AS inline_text FROM d""")
def externalize_bulk(spark, folder):
    d = table(spark, folder, "documents")
    code = F.when(F.col("lang") == "en", "00091010").otherwise("50003000")
    vr = F.when(F.col("source") != "src3", "OW")  # without VR the data stays inline
    out = X.externalize(code, vr, F.col("text").cast("binary"), public_limit=1000)
    return d.select("doc_id", out.alias("o")).select(
        "doc_id", F.col("o.BulkDataURI").alias("uri"), F.col("o.InlineBinary").alias("inline_text")
    )


@query("value_size", """
SELECT vec_id, CAST(4 * len(embedding) AS BIGINT) AS vector_size, CAST(2 * length(CAST(label AS VARCHAR)) + 4 AS BIGINT) AS mixed
FROM embeddings""")
def value_size(spark, folder):
    df = table(spark, folder, "embeddings")
    text = F.col("label").cast("string")
    nested = df.select("vec_id", "embedding", F.array(F.array(text, text), F.array(F.lit(None)), F.lit(None)).alias("n"),
                       F.lit(True).alias("flag"))
    types = nested.schema
    size = X.value_size(F.col("n"), types["n"].dataType) + X.value_size(F.col("flag"), types["flag"].dataType) - 2
    return nested.select("vec_id", X.value_size(F.col("embedding"), types["embedding"].dataType).alias("vector_size"),
                         size.alias("mixed"))


@query("value_size_text", "SELECT doc_id, length(text)::BIGINT AS size FROM documents")
def value_size_text(spark, folder):
    df = table(spark, folder, "documents")
    return df.select("doc_id", X.value_size(F.col("text"), df.schema["text"].dataType).alias("size"))


@query("inline_binary", """
SELECT doc_id, to_base64(encode(text || lang || source)) AS encoded, text AS decoded FROM documents""")
def inline_binary(spark, folder):
    d = table(spark, folder, "documents")
    chunks = F.array(*[F.col(c).cast("binary") for c in ("text", "lang", "source")])
    back = F.unbase64(X.inline_binary(F.array(F.col("text").cast("binary")))).cast("string")
    return d.select("doc_id", X.inline_binary(chunks).alias("encoded"), back.alias("decoded"))


@query("export_cleanup", """
WITH o AS (SELECT 'o' || o_orderkey AS doc, o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders)
SELECT doc, '' AS path, '00080050' AS tag, 'SH' AS vr, o_orderpriority AS values FROM o
UNION ALL SELECT doc, '', '00200011', 'IS', o_custkey || ',7' FROM o
UNION ALL SELECT doc, '', '00091001', CASE o_orderstatus WHEN 'P' THEN 'LO' ELSE 'UI' END,
  CASE o_orderstatus WHEN 'P' THEN 'n' || o_orderkey ELSE '1.2.' || o_orderkey END FROM o
UNION ALL SELECT doc, '', '00104000', 'LT', 'note' FROM o WHERE o_orderstatus = 'F'
UNION ALL SELECT doc, '00101002[0]', '00100020', 'LO', CAST(o_custkey AS VARCHAR) FROM o
UNION ALL SELECT doc, '00101002[1]', '00200013', 'IS', '5' FROM o
UNION ALL SELECT doc, '00101002[2]/00101002[0]/00101002[0]/00101002[0]/00101002[1]', '00100020', 'LO', 'deep' FROM o""")
def export_cleanup(spark, folder):
    """Every order as a document that needs each of the clean-up rules."""
    o = table(spark, folder, "orders")
    status, key = F.col("o_orderstatus"), F.col("o_orderkey").cast("string")
    unknown = F.when(status == "P", F.concat(F.lit("n"), key)).otherwise(F.concat(F.lit("1.2."), key))
    bare = F.when(status == "F", F.lit('{"Value":["note"]}')).when(status == "P", '{"Value":[1]}').otherwise('{"Value":[null]}')
    # Five levels down the rules hold as well.
    deep = '{"00083002":{"vr":"UI","Value":["1"]}},{"00100020":{"vr":"LO","Value":["deep",null]},"00080061":{"vr":"CS","Value":[null]}}'
    for _ in range(4):
        deep = '{"00101002":{"vr":"SQ","Value":[' + deep + "]}}"
    deep = "," + deep
    doc = F.format_string(
        '{"00080050":{"vr":"SH","Value":["%s",null]},"00200011":{"vr":"IS","Value":[%s,7]},'
        '"00083002":{"vr":"UI","Value":["1.2"]},"00091001":{"vr":"UN","Value":["%s"]},'
        '"00104000":%s,"00080060":{"vr":"CS","Value":[]},"00080061":{"vr":"CS","Value":[null]},'
        '"00101002":{"vr":"SQ","Value":[{"00100020":{"vr":"LO","Value":["%s"]}},{"00200013":{"vr":"IS","Value":[5]}}' + deep + "]}}",
        F.col("o_orderpriority"), F.col("o_custkey"), unknown, bare, F.col("o_custkey"),
    )
    docs = o.select(F.concat(F.lit("o"), key).alias("doc"), F.parse_json(doc).alias("document"))
    rows = A.export_attributes(docs, ["doc"], "document", tasks=spark.sparkContext.defaultParallelism)
    return rows.select("doc", "path", "tag", "vr", F.array_join("values", ",").alias("values"))


@query("validate_uids", f"""
WITH {V.SQL_INSTANCES},
l AS (SELECT sop_uid, CASE modality WHEN 'A' THEN study_uid || repeat('.1', 32) ELSE study_uid END AS s,
             CASE modality WHEN 'R' THEN series_uid ELSE series_uid || repeat('9', 50) END AS r FROM instances)
SELECT sop_uid, concat_ws(';', CASE WHEN length(s) > 64 THEN 'StudyInstanceUID too long' END,
  CASE WHEN length(r) > 64 THEN 'SeriesInstanceUID too long' END) AS errors FROM l""")
def validate_uids(spark, folder):
    study = F.when(F.col("modality") == "A", F.concat(F.col("study_uid"), F.repeat(F.lit(".1"), 32))).otherwise(
        F.col("study_uid"))
    series = F.when(F.col("modality") == "R", F.col("series_uid")).otherwise(
        F.concat(F.col("series_uid"), F.repeat(F.lit("9"), 50)))
    return V.instances(spark, folder).select("sop_uid", F.array_join(X.uid_errors(study, series), ";").alias("errors"))


@query("record_diff", """
WITH n AS (SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS seg, c_mktsegment,
  CASE WHEN c_acctbal > 5000 THEN c_nationkey + 1 ELSE c_nationkey END AS nat, c_nationkey FROM customer)
SELECT c_custkey, CASE WHEN seg <> c_mktsegment THEN seg END AS seg, CASE WHEN nat <> c_nationkey THEN nat::VARCHAR END AS nat,
  CAST(NULL AS VARCHAR) AS name, seg = c_mktsegment AND nat = c_nationkey AS same,
  CASE WHEN nat <> c_nationkey THEN 'home' END AS sections FROM n""")
def record_diff(spark, folder):
    c = table(spark, folder, "customer")
    seg = F.when(F.col("c_acctbal") < 0, "DEBT").otherwise(F.col("c_mktsegment"))
    nat = F.when(F.col("c_acctbal") > 5000, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).cast("string")
    base = F.create_map(F.lit("name"), F.col("c_name"), F.lit("seg"), F.col("c_mktsegment"),
                        F.lit("nat"), F.col("c_nationkey").cast("string"), F.lit("gone"), F.lit("x"))
    new = F.create_map(F.lit("name"), F.col("c_name"), F.lit("seg"), seg, F.lit("nat"), nat)
    sections = X.nested_map_diff(
        F.create_map(F.lit("home"), F.create_map(F.lit("nat"), nat), F.lit("id"), F.create_map(F.lit("n"), F.col("c_name"))),
        F.create_map(F.lit("home"), F.create_map(F.lit("nat"), F.col("c_nationkey").cast("string")),
                     F.lit("id"), F.create_map(F.lit("n"), F.col("c_name"))),
    )
    return c.select("c_custkey", X.map_diff(new, base).alias("d"), sections.alias("s")).select(
        "c_custkey", F.col("d")["seg"].alias("seg"), F.col("d")["nat"].alias("nat"), F.col("d")["name"].alias("name"),
        F.col("d").isNull().alias("same"), F.array_join(F.map_keys("s"), ",").alias("sections"),
    )


@query("location_kind", """
WITH l AS (SELECT page_id, url, regexp_extract(url, '[0-9]+') AS n FROM pages)
SELECT page_id, CASE WHEN n <> '' AND n::INT >= 600 THEN 'remote' ELSE 'file' END AS kind,
  CASE WHEN n <> '' AND n::INT >= 600 THEN NULL WHEN n = '' OR n::INT < 200 THEN '/data/' || n
       WHEN n::INT < 400 THEN 'C:/data/' || n ELSE 'archive/' || n END AS path FROM l""")
def location_kind(spark, folder):
    n = F.regexp_extract("url", "[0-9]+", 0)
    num = n.try_cast("int")
    location = (
        F.when(num >= 600, F.col("url"))
        .when(num.isNull() | (num < 200), F.concat(F.lit(" FILE:///data/"), n))
        .when(num < 400, F.concat(F.lit("C:/data/"), n))
        .otherwise(F.concat(F.lit("archive/"), n))
    )
    return table(spark, folder, "pages").select("page_id", P.location_kind(location).alias("l")).select("page_id", "l.*")


@query("frame_bytes", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CAST((l_partkey + 1) * (l_suppkey + 1) * 3 * CASE WHEN l_linestatus = 'O' THEN 16 ELSE 8 END / 8 AS BIGINT) AS bytes
FROM lineitem""")
def frame_bytes(spark, folder):
    bits = F.when(F.col("l_linestatus") == "O", 16).otherwise(8)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        X.frame_bytes(F.col("l_partkey") + 1, F.col("l_suppkey") + 1, F.lit(3), bits).alias("bytes"),
    )


@query("image_class", """
WITH i AS (SELECT p_partkey, CASE WHEN p_size < 15 THEN 32 WHEN p_size < 35 THEN 16 ELSE 8 END AS bits,
  CASE WHEN p_retailprice < 930 THEN NULL ELSE p_size % 2 END AS rep,
  CASE p_type WHEN 'SMALL' THEN 'RGB' WHEN 'PROMO' THEN 'YBR_FULL' ELSE 'MONOCHROME2' END AS photo,
  CASE WHEN p_type = 'SMALL' THEN 3 ELSE 1 END AS samples,
  CASE p_brand WHEN 'Brand#1' THEN '1.2.840.10008.5.1.4.1.1.12.1' ELSE '1.2.3' END AS cls FROM part)
SELECT p_partkey, CASE WHEN bits = 32 THEN 'float32' WHEN bits = 16 AND coalesce(rep, 0) = 0 THEN 'uint16'
  WHEN bits = 16 THEN 'int16' ELSE 'uint8' END AS pixel_type, coalesce(rep, 0) = 1 AS signed,
  photo IN ('RGB', 'YBR_FULL') AS color, bits = 8 AND samples = 3 AS baseline_jpeg_color,
  cls = '1.2.3' AS modality_lut FROM i""")
def image_class(spark, folder):
    t, size = F.col("p_type"), F.col("p_size")
    bits = F.when(size < 15, 32).when(size < 35, 16).otherwise(8)
    rep = F.when(F.col("p_retailprice") >= 930, size % 2)
    photo = F.when(t == "SMALL", "RGB").when(t == "PROMO", "YBR_FULL").otherwise("MONOCHROME2")
    cls = F.when(F.col("p_brand") == "Brand#1", "1.2.840.10008.5.1.4.1.1.12.1").otherwise("1.2.3")
    info = X.image_class(bits, rep, photo, F.when(t == "SMALL", 3).otherwise(1), F.lit(X.BASELINE_JPEG), cls)
    return table(spark, folder, "part").select("p_partkey", info.alias("i")).select("p_partkey", "i.*")
