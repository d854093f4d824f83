"""Queries of sources, sinks and extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import paths as P
from scanloom.functions import tags as G
from scanloom.operators import filters as Q
from scanloom.operators import hierarchy as H
from scanloom.operators import plugins as U
from scanloom.plans import view as V
from scanloom.plans.registry import query, table
from scanloom.session import new_folder
from scanloom.sources import documents as D
from scanloom.sources import files as L
from scanloom.sources import sinks as K


@query("read_dicom_json", """
SELECT event_id, event_type <> 'error' AS ok,
  CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def read_dicom_json(spark, folder):
    """Event documents, those of errors cut short: good rows and quarantined rows."""
    text = F.when(F.col("event_type") == "error", F.regexp_replace("props", "}$", "")).otherwise(F.col("props"))
    docs = table(spark, folder, "events").select("event_id", text.alias("text"))
    good, bad = D.split_documents(D.parse_documents(docs, "text"))
    k = F.try_variant_get("document", "$.k", "bigint")
    return good.select("event_id", F.lit(True).alias("ok"), k.alias("k")).unionByName(
        bad.select("event_id", F.lit(False).alias("ok"), F.lit(None).cast("bigint").alias("k"))
    )


@query("read_dataset_files", """
SELECT 'n' || o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN 'CT' END AS modality FROM orders""")
def read_dataset_files(spark, folder):
    """Orders written as gzip JSON files and read back as datasets."""
    o = table(spark, folder, "orders")
    uid = F.concat(F.lit("n"), V.text("o_orderkey"))
    modality = F.when(F.col("o_orderstatus") == "P", '{"vr":"CS"}').otherwise('{"vr":"CS","Value":["CT"]}')
    doc = F.concat(F.lit('{"00080018":{"vr":"UI","Value":["'), uid, F.lit('"]},"00080060":'), modality, F.lit("}"))
    path = new_folder(spark, "documents")
    o.select(doc.alias("value")).write.option("compression", "gzip").text(path)
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("document"))
    ds = D.as_datasets(lines)
    return ds.select(G.get_value(F.col("ds"), "SOPInstanceUID").alias("id"),
                     F.nullif(G.get_value(F.col("ds"), "Modality"), F.lit("")).alias("modality"))


NAMES_SQL = """
n AS (SELECT page_id, url, 'a/' || CASE lower(right(url, 1)) WHEN '0' THEN '.git/x' || page_id WHEN '1' THEN '__MACOSX/x.dcm'
  WHEN '2' THEN 'scan' || page_id || '.DCM' WHEN '3' THEN 'note.TXT' WHEN '4' THEN 'DICOMDIR' WHEN '5' THEN 'im.7z'
  ELSE 'img' || page_id END AS path FROM pages)"""


def names(spark, folder):
    last = F.lower(F.right("url", F.lit(1)))
    page = V.text("page_id")
    name = (
        F.when(last == "0", F.concat(F.lit(".git/x"), page)).when(last == "1", "__MACOSX/x.dcm")
        .when(last == "2", F.concat(F.lit("scan"), page, F.lit(".DCM"))).when(last == "3", "note.TXT")
        .when(last == "4", "DICOMDIR").when(last == "5", "im.7z").otherwise(F.concat(F.lit("img"), page))
    )
    return table(spark, folder, "pages").select("page_id", "url", F.concat(F.lit("a/"), name).alias("path"))


@query("scan_files", f"""WITH {NAMES_SQL}
SELECT page_id, 'p' || page_id % 7 || '/p' || page_id || '/' || path AS path, strlen(url)::BIGINT AS length FROM n
WHERE lower(right(url, 1)) NOT IN ('0', '1')""")
def scan_files(spark, folder):
    """A file for every page, in nested folders, some of them hidden; listed below two roots, one of which is not there."""
    page = V.text("page_id")
    path = F.concat(F.lit("p"), (F.col("page_id") % 7).cast("string"), F.lit("/p"), page, F.lit("/"), F.col("path"))
    root = new_folder(spark, "scan")
    L.write_files(names(spark, folder).select(path.alias("path"), F.col("url").alias("content")), root)
    files = L.list_tree(spark, [root, f"{root}/nowhere"])
    page_id = F.regexp_extract("relative", "^p[0-9]/p([0-9]+)/", 1).cast("bigint")
    return files.select(page_id.alias("page_id"), F.col("relative").alias("path"), "length")


@query("filter_input_names", f"""WITH {NAMES_SQL}
SELECT page_id, path, lower(right(url, 1)) NOT IN ('3', '4', '5') AS input FROM n""")
def filter_input_names(spark, folder):
    return names(spark, folder).select("page_id", "path", P.is_input_name(F.col("path")).alias("input"))


KEY_SQL = """
f AS (SELECT page_id, strlen(html)::BIGINT AS size, 'studies/1.' || page_id || CASE lower(right(url, 1)) WHEN '0' THEN '/index.json.gz'
  WHEN '1' THEN '/frames/1.mht.gz' WHEN '2' THEN '/series' WHEN '3' THEN '/bulkdata/x.br' WHEN '4' THEN '/thumbnail'
  WHEN '5' THEN '/1.jhc' WHEN '6' THEN '/x.jls' WHEN '7' THEN '/rendered' WHEN '8' THEN '/theme/a.js' WHEN '9' THEN '/index.mht'
  WHEN 'e' THEN '/' ELSE '/metadata.gz' END AS file FROM pages)"""


def files(spark, folder):
    last = F.lower(F.right("url", F.lit(1)))
    tails = {
        "0": "/index.json.gz", "1": "/frames/1.mht.gz", "2": "/series", "3": "/bulkdata/x.br", "4": "/thumbnail",
        "5": "/1.jhc", "6": "/x.jls", "7": "/rendered", "8": "/theme/a.js", "9": "/index.mht", "e": "/",
    }
    tail = F.coalesce(F.create_map(*[F.lit(x) for p in tails.items() for x in p])[last], F.lit("/metadata.gz"))
    return table(spark, folder, "pages").select(
        "page_id", F.octet_length("html").cast("bigint").alias("size"),
        F.concat(F.lit("studies/1."), V.text("page_id"), tail).alias("file"),
    )


@query("list_objects", f"""WITH {KEY_SQL}
SELECT 'archive/' || file AS key, size, file AS relative_uri, CASE WHEN suffix(file, 'thumbnail') THEN file
  WHEN suffix(file, '/series') THEN file || '/index.json.gz'
  WHEN suffix(file, '.gz') OR suffix(file, '.jls') THEN file ELSE file || '.gz' END AS file_name FROM f WHERE NOT suffix(file, '/')""")
def list_objects(spark, folder):
    """The pages stored as objects below two prefixes; the objects of one of them."""
    stored = files(spark, folder).where(~F.col("file").endswith("/")).join(table(spark, folder, "pages").select("page_id", "html"), "page_id")
    root = new_folder(spark, "store")
    prefix = F.explode(F.array(F.lit("archive/"), F.lit("other/")))
    L.write_files(stored.select(prefix.alias("prefix"), "file", "html").select(F.concat("prefix", "file").alias("path"), F.col("html").alias("content")), root)
    return D.list_objects(spark, root, "archive/").drop("modificationTime")


@query("object_key", f"""WITH {KEY_SQL}
SELECT page_id, file, 'web/studies/1.' || page_id || CASE right(file, 7) WHEN 'json.gz' THEN '' WHEN '.mht.gz' THEN '/frames/1'
  ELSE CASE WHEN suffix(file, '/series') THEN '/series' WHEN suffix(file, 'x.br') THEN '/bulkdata/x'
  WHEN suffix(file, 'thumbnail') THEN '/thumbnail' WHEN suffix(file, '1.jhc') THEN '/1' WHEN suffix(file, '.jls') THEN '/x.jls'
  WHEN suffix(file, 'rendered') THEN '/rendered' WHEN suffix(file, 'a.js') THEN '/theme/a.js' WHEN suffix(file, 'index.mht') THEN ''
  WHEN suffix(file, '/') THEN '/' ELSE '/metadata' END END AS key FROM f""")
def object_key(spark, folder):
    return files(spark, folder).select("page_id", "file", P.object_key(F.col("file"), "/web").alias("key"))


@query("key_to_file", f"""WITH {KEY_SQL}
SELECT page_id, CASE WHEN suffix(file, 'thumbnail') THEN file WHEN suffix(file, '/') THEN file || 'index.json.gz'
  WHEN suffix(file, '/series') THEN file || '/index.json.gz' WHEN suffix(file, '.gz') OR suffix(file, '.jls') THEN file
  ELSE file || '.gz' END AS name FROM f""")
def key_to_file(spark, folder):
    return files(spark, folder).select("page_id", P.key_to_file(F.col("file")).alias("name"))


@query("content_headers", f"""WITH {KEY_SQL}
SELECT page_id, CASE WHEN contains(file, 'index.json') THEN 'application/json' WHEN contains(file, '.mht') THEN 'multipart/related'
  WHEN contains(file, 'bulkdata') THEN 'application/octet-stream' WHEN contains(file, 'thumbnail') THEN 'image/jpeg'
  WHEN contains(file, '.jls') THEN 'image/jls' WHEN contains(file, 'rendered') THEN 'image/png'
  WHEN contains(file, 'a.js') THEN 'text/javascript' ELSE 'application/json' END AS type,
  CASE WHEN contains(file, '.br') THEN 'brotli' WHEN contains(file, '.gz') THEN 'gzip' END AS encoding,
  CASE WHEN contains(file, 'theme/') OR contains(file, 'index.js') THEN 'no-cache' END AS cache FROM f""")
def content_headers(spark, folder):
    f = F.col("file")
    return files(spark, folder).select(
        "page_id", P.content_type(f).alias("type"), P.content_encoding(f).alias("encoding"), P.cache_control(f).alias("cache")
    )


@query("read_ndjson_results", """
SELECT DISTINCT CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END AS outcome, 'set' || user_id AS image_set_id
FROM events WHERE event_type <> 'view'""")
def read_ndjson_results(spark, folder):
    """Result lines written per outcome and read back as NDJSON."""
    outcome = F.when(F.col("event_type") == "error", "failure").otherwise("success")
    uid = F.when(F.col("event_type") != "view", F.concat(F.lit("set"), V.text("user_id")))
    rows = table(spark, folder, "events").select(
        F.struct(uid.alias("imageSetId")).alias("importResponse"), outcome.alias("outcome")
    )
    path = new_folder(spark, "results")
    rows.write.partitionBy("outcome").json(path)
    ids = [D.read_import_results(spark, f"{path}/outcome={kind}").withColumn("outcome", F.lit(kind)) for kind in ("failure", "success")]
    return ids[0].unionByName(ids[1]).select("outcome", "image_set_id")


@query("read_document_files", """
SELECT s_suppkey, s_suppkey % 5 <> 0 AS ok, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS name FROM supplier""")
def read_document_files(spark, folder):
    """A JSON file per supplier, every third packed; of every fifth the end is missing."""
    s = table(spark, folder, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_name").alias("name"))).alias("text"))
    broken = F.col("s_suppkey") % 5 == 0
    text = F.when(broken, F.expr("left(text, length(text) - 3)")).otherwise(F.col("text"))
    packed = F.col("s_suppkey") % 3 == 0
    path = F.concat(F.lit("s"), V.text("s_suppkey"), F.when(packed, ".json.gz").otherwise(".json"))
    root = new_folder(spark, "documents")
    L.write_files(s.select(path.alias("path"), text.alias("content")), root, packed=True)
    docs = D.read_documents(spark, root)
    key = F.regexp_extract("path", r"/s([0-9]+)[.]json(?:[.]gz)?$", 1).cast("bigint")
    return docs.select(key.alias("s_suppkey"), "ok", F.try_variant_get("document", "$.name", "string").alias("name"))


@query("multipart_scan", """
WITH c AS (SELECT *, encode(text) || '\\x00\\xFF\\x0D\\x0A'::BLOB AS bytes FROM conversations)
SELECT conv_id, turn, CASE role WHEN 'user' THEN '--B' || conv_id END AS separator,
  CASE role WHEN 'user' THEN 'image/jls' ELSE 'application/octet-stream' END AS content_type,
  CASE role WHEN 'user' THEN '1.2.840.10008.1.2.4.80' END AS transfer_syntax, part, hex(bytes)[part * 128 + 1:part * 128 + 128] AS slice
FROM (SELECT *, unnest(range((octet_length(bytes) + 63) // 64)) AS part FROM c)""")
def multipart_scan(spark, folder):
    """Turns as files with binary payloads, those of users wrapped as multipart; headers are read by their place, payloads in slices."""
    mark = F.concat(F.lit("--B"), V.text("conv_id"))
    payload = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("00FF0D0A")))
    head = F.concat(mark, F.lit("\r\nContent-Type: image/jls;transfer-syntax=1.2.840.10008.1.2.4.80; x=1\r\nContent-Location: 1.mht\r\n\r\n"))
    wrapped = F.concat(head.cast("binary"), payload, F.concat(F.lit("\r\n"), mark, F.lit("--\r\n")).cast("binary"))
    content = F.when(F.col("role") == "user", wrapped).otherwise(payload)
    path = F.concat(F.lit("c"), V.text("conv_id"), F.lit("/"), V.text("turn"), F.lit(".mht"))
    root = new_folder(spark, "bulkdata")
    L.write_files(table(spark, folder, "conversations").select(path.alias("path"), content.alias("content")), root)
    slices = L.payload_slices(L.multipart_headers(L.list_tree(spark, root)), slice_bytes=64)
    place = [F.regexp_extract("relative", "^c([0-9]+)/([0-9]+)", i).cast("bigint") for i in (1, 2)]
    return slices.select(place[0].alias("conv_id"), place[1].alias("turn"), "separator", "content_type", "transfer_syntax",
                         "part", F.hex("content").alias("slice"))


@query("multipart_fields", """
SELECT conv_id, turn, CASE role WHEN 'user' THEN '--B' || conv_id END AS separator,
  CASE role WHEN 'user' THEN 'image/jls' ELSE 'application/octet-stream' END AS content_type,
  CASE role WHEN 'user' THEN '1.2.840.10008.1.2.4.80' END AS transfer_syntax, text AS payload FROM conversations""")
def multipart_fields(spark, folder):
    """User turns wrapped as multipart contents in a column, the others plain."""
    mark = F.concat(F.lit("--B"), V.text("conv_id"))
    wrapped = F.concat(
        mark, F.lit("\r\nContent-Type: image/jls;transfer-syntax=1.2.840.10008.1.2.4.80; x=1\r\nContent-Location: 1.mht\r\n\r\n"),
        F.col("text"), F.lit("\r\n"), mark, F.lit("--\r\n"),
    )
    content = F.when(F.col("role") == "user", wrapped).otherwise(F.col("text")).cast("binary")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", D.multipart_fields(content).alias("m"))
    return rows.select("conv_id", "turn", "m.separator", "m.content_type", "m.transfer_syntax",
                       F.col("m.payload").cast("string").alias("payload"))


@query("write_archive", f"""WITH {V.SQL_INSTANCES}
SELECT study_uid, count(*) AS n, string_agg(modality, '' ORDER BY sop_uid) AS flags FROM instances GROUP BY study_uid""")
def write_archive(spark, folder):
    """Instances written as a parquet archive and read back."""
    path = new_folder(spark, "archive")
    K.write_archive(V.instances(spark, folder), path, buckets=8)
    back = K.read_archive(spark, path)
    per_line = back.groupBy("study_uid", "sop_uid").agg(F.count(F.lit(1)).alias("c"), F.min("modality").alias("m"))
    rows = per_line.groupBy("study_uid").agg(
        F.sum("c").alias("n"), F.array_sort(F.collect_set(F.struct("sop_uid", "m"))).alias("s")
    )
    return rows.select("study_uid", "n", F.array_join(F.transform("s", lambda x: x["m"]), "").alias("flags"))


@query("archive_paths", f"""WITH {V.SQL_INSTANCES}
SELECT sop_uid, 'studies/' || study_uid || '/series/' || series_uid || '/instances/' || sop_uid AS path,
  'studies/' || sha256(study_uid)[1:3] || '/' || sha256(study_uid)[4:6] || '/' || study_uid || '/series/' || series_uid AS hashed,
  'studies/' || study_uid || '/series/' || series_uid || '/instances/' || sop_uid || '/frames/' || n_frames AS frame FROM instances""")
def archive_paths(spark, folder):
    st, se, so = F.col("study_uid"), F.col("series_uid"), F.col("sop_uid")
    return V.instances(spark, folder).select(
        "sop_uid", P.archive_path(st, se, so).alias("path"), P.archive_path(st, se, hashed=True).alias("hashed"),
        P.archive_path(st, se, so, F.col("n_frames")).alias("frame"),
    )


@query("bulkdata_store", """
WITH h AS (SELECT sha256(text) AS hash, doc_id, strlen(text)::BIGINT AS size FROM documents)
SELECT hash, min(size) AS size, min(doc_id) AS first_user, count(*) AS n_users,
  hash[1:2] || '/' || hash[3:4] || '/' || hash[5:] || '.mht.gz' AS path FROM h GROUP BY hash""")
def bulkdata_store(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return K.bulkdata_rows(d, "content", "doc_id").drop("content")


@query("bulkdata_chunks", """
WITH h AS (SELECT sha256(text) AS hash, doc_id, strlen(text)::BIGINT AS size FROM documents)
SELECT hash, min(size) AS size, greatest(1, ceil(min(size) / 512))::BIGINT AS n_parts, min(doc_id) AS first_user, count(*) AS n_users,
  hash[1:2] || '/' || hash[3:4] || '/' || hash[5:] || '.mht.gz' AS path FROM h GROUP BY hash""")
def bulkdata_chunks(spark, folder):
    """Documents in chunks of 512 bytes, stored once per content; sizes and numbers of chunks as the store has them."""
    d = table(spark, folder, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    contents, stored = K.chunked_bulkdata(K.chunk_rows(d, "doc_id", "content", 512), "doc_id")
    path = new_folder(spark, "chunks")
    K.write_chunks(stored, path)
    back = spark.read.schema("hash string, part int, content binary, prefix string").parquet(path)
    sizes = back.groupBy("hash").agg(F.sum(F.octet_length("content")).cast("bigint").alias("size"), F.count(F.lit(1)).alias("n_parts"))
    return contents.select("hash", "first_user", "n_users", "path").join(sizes, "hash")


@query("find_objects", f"""WITH {V.SQL_INSTANCES}
SELECT study_uid, series_uid, sop_uid, modality, n_frames FROM instances WHERE sop_uid IN ('1.2.33.1', '1.2.7.2', '1.2.0.9')""")
def find_objects(spark, folder):
    """Objects looked up by UID in the stored archive, one of them not there."""
    path = new_folder(spark, "archive")
    K.write_archive(V.instances(spark, folder), path, buckets=8)
    rows = K.find_objects(K.read_archive(spark, path), ["1.2.33.1", "1.2.7.2", "1.2.0.9"])
    return rows.select("study_uid", "series_uid", "sop_uid", "modality", "n_frames")


XML_SQL = K.XML_HEAD.replace("\n", "' || chr(10) || '")


@query("export_xml", f"""
SELECT o_orderkey, '{XML_SQL}' || chr(10) || '<DicomAttribute tag="00080050" vr="SH">' || chr(10)
  || '<Value number="1">' || o_orderpriority || ' &lt;&amp;</Value>' || chr(10) || '<Value number="2">b</Value>' || chr(10)
  || '</DicomAttribute>' || chr(10) || '<DicomAttribute tag="00101002" vr="SQ">' || chr(10) || '<Item number="1">' || chr(10)
  || '<DicomAttribute tag="00100020" vr="LO">' || chr(10) || '<Value number="1">' || o_custkey || '</Value>' || chr(10)
  || '</DicomAttribute>' || chr(10) || '</Item>' || chr(10)
  || '<Item number="2">' || chr(10) || repeat('<DicomAttribute tag="00101002" vr="SQ">' || chr(10) || '<Item number="1">' || chr(10), 4)
  || '<DicomAttribute tag="00100020" vr="LO">' || chr(10) || '<Value number="1">deep</Value>' || chr(10) || '</DicomAttribute>' || chr(10)
  || repeat('</Item>' || chr(10) || '</DicomAttribute>' || chr(10), 5) || '</NativeDicomModel>' AS xml FROM orders""")
def export_xml(spark, folder):
    deep = '{"00100020":{"vr":"LO","Value":["deep"]}}'
    for _ in range(4):
        deep = '{"00101002":{"vr":"SQ","Value":[' + deep + "]}}"
    doc = F.format_string(
        '{"00101002":{"vr":"SQ","Value":[{"00100020":{"vr":"LO","Value":["%s"]}},' + deep + ']},'
        '"00080050":{"vr":"SH","Value":["%s <&","b"]},"00080090":{"vr":"PN"}}',
        F.col("o_custkey"), F.col("o_orderpriority"),
    )
    o = table(spark, folder, "orders").select("o_orderkey", F.parse_json(doc).alias("document"))
    return o.select("o_orderkey", K.dataset_xml(F.col("document")).alias("xml"))


@query("export_plan", f"""WITH {V.SQL_INSTANCES},
asked AS (SELECT '1.2.' || o_orderkey AS study_uid, '1.2.' || o_orderkey || '.1' AS sop_uid FROM orders WHERE o_orderstatus = 'F')
SELECT a.study_uid, i.series_uid, a.sop_uid, 'studies/' || i.study_uid || '/series/' || i.series_uid || '/instances/' || i.sop_uid || '.dcm' AS target,
  CASE WHEN i.sop_uid IS NULL THEN 'missing' ELSE 'export' END AS status
FROM asked a LEFT JOIN instances i ON a.study_uid = i.study_uid AND a.sop_uid = i.sop_uid""")
def export_plan(spark, folder):
    """First line of every finished order; some orders have none."""
    uid = F.concat(F.lit("1.2."), V.text("o_orderkey"))
    asked = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(
        uid.alias("study_uid"), F.concat(uid, F.lit(".1")).alias("sop_uid")
    )
    return K.export_plan(V.instances(spark, folder), asked, requested=asked)


@query("register_query", """
SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 1000""")
def register_query(spark, folder):
    def low_balance(df, params):
        return Q.qido_filter(df, params).where(F.col("c_acctbal") < 1000)

    U.register_query("low_balance", low_balance)
    c = table(spark, folder, "customer").withColumn("description", F.col("c_mktsegment"))
    return U.run_query("low_balance", c, {"StudyDescription": "BUILDING"}).select("c_custkey", "c_name")


@query("series_index_plugin", f"""WITH {V.SQL_INSTANCES},{V.SQL_SERIES}
SELECT study_uid, series_uid, modality, n_instances FROM series WHERE study_uid = '1.2.11'""")
def series_index_plugin(spark, folder):
    """The series table is stored in study buckets and read back for one study."""
    path = new_folder(spark, "series")
    K.write_archive(H.series_summary(V.instances(spark, folder), V.INSTANCE_COLUMNS), path, buckets=8)
    rows = U.read_series_index(spark, path, "1.2.11", buckets=8)
    return rows.select("study_uid", "series_uid", "modality", "n_instances")


@query("validate_hook", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, concat_ws(',', CASE WHEN l_quantity > 45 THEN 'too many frames' END,
  CASE WHEN l_discount > 0.09 THEN 'discount' END, CASE WHEN o_orderkey IS NULL THEN 'no study' END) AS errors
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey""")
def validate_hook(spark, folder):
    li = table(spark, folder, "lineitem")
    o = table(spark, folder, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"], "left")
    checked = U.validate(rows, {
        "too many frames": F.col("l_quantity") <= 45,
        "discount": F.col("l_discount") <= 0.09,
        "no study": F.col("o_orderkey").isNotNull(),
    })
    # One pass: the errors column stays, rows without errors are the valid ones.
    return checked.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.array_join("errors", ",").alias("errors"))


