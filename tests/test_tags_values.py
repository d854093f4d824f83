import json

import pytest
from pyspark.sql import functions as F

from scanloom.functions import paths as P
from scanloom.functions import tags as G
from scanloom.functions import values as X
from scanloom.model import tag_dictionary
from scanloom.operators import attributes as A
from scanloom.sources import sinks as K

DOC = {
    "0020000D": {"vr": "UI", "Value": ["1.2.7"]},
    "00100010": {"vr": "PN", "Value": [{"Alphabetic": "Doe^Jo"}]},
    "00080060": {"vr": "CS", "Value": ["A\\B"]},
    "00281050": {"vr": "DS", "Value": [40.5, -600]},
    "00080090": {"vr": "PN"},
    "00080050": {"vr": "SH", "Value": []},
    "00200010": {"vr": "SH", "Value": [""]},
    "00090010": {"vr": "LO", "Value": ["ACME"]},
    "0009001A": {"vr": "LO", "Value": ["OTHER"]},
    "00091001": {"vr": "UN", "InlineBinary": "AAEC"},
}


@pytest.fixture(scope="module")
def doc(spark):
    from scanloom.model import DATASET_TYPE

    return spark.createDataFrame([(json.dumps(DOC),)], "t string").select(F.from_json("t", DATASET_TYPE).alias("ds"))


def one(df, *cols):
    return tuple(df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_tag_states(doc):
    ds = F.col("ds")
    got = one(
        doc, G.get_value(ds, "StudyInstanceUID"), G.get_value(ds, "StudyDate"), G.get_value(ds, "AccessionNumber"),
        G.get_value(ds, "StudyID"), G.get_value(ds, "WindowCenter"), G.get_value(ds, "ReferringPhysicianName"),
        G.get_value(ds, "Modality"),
    )
    assert got == ("1.2.7", None, "", "", "40.5\\-600", None, "A\\B")
    assert one(doc, G.get_list(ds, "AccessionNumber"), G.get_list(ds, "StudyDate")) == ([], None)


def test_private_blocks(doc):
    ds = F.col("ds")
    assert one(
        doc, G.private_tag(ds, "00091001", "ACME"), G.private_tag(ds, "00090002", "OTHER"),
        G.private_tag(ds, "00091001", "NONE"), G.reserve_private_block(ds, "00091001", "NONE"),
    ) == ("00091001", "00091A02", None, "00091101")
    new = G.put_private(ds, "00091005", "NEW", "LO", F.array(F.lit("v")))
    assert one(doc, new["00090011"]["Value"], new["00091105"]["Value"]) == (["NEW"], ["v"])


def test_set_push_remove(doc):
    ds = F.col("ds")
    out = G.push_list(G.set_value(ds, "StudyID", F.array(F.lit("a"))), "StudyID", F.lit("b"))
    assert one(doc, G.get_list(out, "StudyID"), out["00200010"]["vr"]) == (["a", "b"], "SH")
    assert one(doc, G.get_list(G.remove_value(ds, "StudyID"), "StudyID")) == (None,)


def test_content_hash_separators(spark):
    a = G.dataset({"StudyID": F.lit("x=SH=y"), "AccessionNumber": F.lit("z")})
    b = G.dataset({"StudyID": F.lit("x\\=SH=y"), "AccessionNumber": F.lit("z")})
    row = spark.range(1).select(G.content_hash(a).alias("a"), G.content_hash(b).alias("b"))
    assert row.first().a != row.first().b
    two = F.create_map(F.lit("00080008"), G.attribute("CS", F.array(F.lit("a"), F.lit("b"))))
    esc = F.create_map(F.lit("00080008"), G.attribute("CS", F.array(F.lit("a\\b"))))
    r = spark.range(1).select(G.content_hash(two).alias("a"), G.content_hash(esc).alias("b")).first()
    assert r.a != r.b


def test_document_hash_ignores_key_order(spark):
    rows = spark.createDataFrame([('{"a":1,"b":{"x":[1,2],"y":null}}', '{"b":{"y":null,"x":[1,2]},"a":1}')], "l string, r string")
    r = rows.select(G.document_hash(F.col("l")).alias("l"), G.document_hash(F.col("r")).alias("r")).first()
    assert r.l == r.r


def test_typed_values(spark):
    df = spark.createDataFrame([("DS", "1.5\\-2e1\\x"), ("IS", "3\\4.9"), ("PN", "A^B\\C"), ("CS", "A\\B"), ("LO", ""), ("US", "7\\8"), ("OB", "YWJj")], "vr string, raw string")
    got = [r.t for r in df.select(G.typed_values(F.col("vr"), F.col("raw")).alias("t")).collect()]
    assert got[0].decimals == [1.5, -20.0, None]
    assert got[1].integers == [3, 4]
    assert [n.Alphabetic for n in got[2].names] == ["A^B", "C"]
    assert got[3].texts == ["A\\B"]
    assert got[4].texts == []
    assert got[5].integers == [7, 8] and bytes(got[6].bytes) == b"abc" and got[6].texts is None


def test_vr_lookup_is_broadcast(spark):
    rows = spark.createDataFrame([("00080060", None), ("00191234", None), ("00100010", "LO")], "tag string, vr string")
    df = G.with_vr(rows)
    assert set(df.collect()) == set(G.with_vr(rows, tag_dictionary(spark)).collect())
    assert {(r.tag, r.vr) for r in df.collect()} == {("00080060", "CS"), ("00191234", "UN"), ("00100010", "LO")}
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "text, frames, invalid",
    [("1-3,17", [1, 2, 3, 17], False), ("", [1], False), ("3,1,3", [1, 3], False), ("5-2", None, True),
     ("a", None, True), ("1, 2-3", [1, 2, 3], False), ("-5", None, True), (None, [1], False)],
)
def test_frame_list(spark, text, frames, invalid):
    df = spark.createDataFrame([(text,)], "t string").select(X.parse_frame_list(F.col("t")).alias("r"))
    r = df.first().r
    assert (r.frames, r.error is not None) == (frames, invalid)


@pytest.mark.parametrize(
    "text, size", [("10k", 10240), ("1.5g", 1610612736), ("10 MB", 10485760), ("2t", 2199023255552), ("123", 123),
                   ("10b", None), ("x", None), ("-1k", None)],
)
def test_size(spark, text, size):
    assert spark.createDataFrame([(text,)], "t string").select(X.parse_size(F.col("t")).alias("r")).first().r == size


@pytest.mark.parametrize("text, ms", [("10h", 36000000), ("1.5m", 90000), ("3600", 3600000), ("3s", 3000), ("3d", None)])
def test_duration(spark, text, ms):
    assert spark.createDataFrame([(text,)], "t string").select(X.parse_duration(F.col("t")).alias("r")).first().r == ms


@pytest.mark.parametrize(
    "location, kind, path",
    [("/a/b", "file", "/a/b"), ("file:///a%20b", "file", "/a b"), ("C:\\x", "file", "C:\\x"), ("https://h/x", "remote", None),
     ("s3://b/k", "remote", None), ("file:/a+b%zz", "file", "file:/a+b%zz"), ("file:/a+b", "file", "/a+b"), ("  ", "remote", None), ("c:x", "remote", None)],
)
def test_location(spark, location, kind, path):
    r = spark.createDataFrame([(location,)], "t string").select(P.location_kind(F.col("t")).alias("r")).first().r
    assert (r.kind, r.path) == (kind, path)


@pytest.mark.parametrize(
    "file, key",
    [("studies/1/index.json.gz", "studies/1"), ("a\\b.json", "a/b.json"), ("/x/1.mht.gz", "x/1"), ("f.mht/g.mht", "f.mht/g"),
     ("1.jhc", "1"), (".mht", ".mht"), ("x.br", "x")],
)
def test_object_key(spark, file, key):
    assert spark.createDataFrame([(file,)], "t string").select(P.object_key(F.col("t")).alias("r")).first().r == key


def test_reject_path(spark):
    df = spark.createDataFrame([("1.2/series/3.4/instances/5.6",), ("/x/studies/1.2/3.4",), ("1.2",)], "t string")
    got = [tuple(r.r) for r in df.select(P.parse_reject_path(F.col("t")).alias("r")).collect()]
    assert got == [("1.2", "3.4", "5.6"), ("1.2", "3.4", None), (None, None, None)]


def test_bulk_uri_rewrite_at_depth(spark):
    doc = json.dumps({"a": {"BulkDataURI": "./frames/1"}, "s": {"Value": [{"b": {"BulkDataURI": "../../../../bulkdata/x"}}]},
                      "t": {"Value": ['say "BulkDataURI":"./frames"']}})
    out = spark.createDataFrame([(doc,)], "d string").select(P.rewrite_bulk_uris(F.col("d"), F.lit("9.9")).alias("r")).first().r
    got = json.loads(out)
    assert got["a"]["BulkDataURI"] == "./instances/9.9/frames"
    assert got["s"]["Value"][0]["b"]["BulkDataURI"] == "../../bulkdata/x"
    assert got["t"] == json.loads(doc)["t"]


def test_attributes_of_nested_sequences(spark):
    doc = {"00101002": {"vr": "SQ", "Value": [{"00101002": {"vr": "SQ", "Value": [{"00100020": {"vr": "LO", "Value": ["x"]}}]}}]},
           "00080090": {"vr": "SQ"}, "00080060": {"Value": ["CT"]}}
    docs = spark.createDataFrame([("d", json.dumps(doc))], "id string, t string").select("id", F.parse_json("t").alias("v"))
    rows = {(r.path, r.tag) for r in A.explode_attributes(docs, ["id"], "v").collect()}
    assert rows == {("00101002[0]/00101002[0]", "00100020"), ("", "00080090"), ("", "00080060")}
    odd = spark.createDataFrame([("d", '{"00080060":{"vr":"CS","Value":"CT"},"x":"y","00200011":{"vr":"IS","Value":7}}')], "id string, t string")
    got = A.export_cleanup(A.explode_attributes(odd.select("id", F.parse_json("t").alias("v")), ["id"], "v"))
    assert {r.tag: r["values"] for r in got.collect()} == {"00080060": ["CT"], "00200011": ["7"]}
    clean = {r.tag: r.vr for r in A.export_cleanup(A.explode_attributes(docs, ["id"], "v")).collect()}
    assert clean["00080060"] == "LT"


def test_record_diff(spark):
    m = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), F.lit(v))])
    r = spark.range(1).select(
        X.map_diff(m(a="1", b="2"), m(a="1", b="3", c="4")).alias("d"), X.map_diff(m(a="1"), m(a="1")).alias("same"),
    ).first()
    assert r.d == {"b": "2"} and r.same is None


def test_xml(spark, tmp_path):
    import xml.etree.ElementTree as ET

    doc = json.dumps({"00080050": {"vr": "SH", "Value": ["a<b\nc"]}, "00101002": {"vr": "SQ", "Value": [{"00100020": {"vr": "LO", "Value": ["p"]}}]}})
    docs = spark.createDataFrame([(doc,)], "t string").select(F.parse_json("t").alias("v"))
    root = ET.fromstring(docs.select(K.dataset_xml(F.col("v")).alias("x")).first().x)
    ns = "{http://dicom.nema.org/PS3.19/models/NativeDICOM}"
    assert [e.get("tag") for e in root.findall(f"{ns}DicomAttribute")] == ["00080050", "00101002"]
    K.write_xml(docs, "v", str(tmp_path / "xml"))
    line = spark.read.text(str(tmp_path / "xml")).collect()
    assert len(line) == 1
    assert ET.fromstring(line[0].value).find(f"{ns}DicomAttribute/{ns}Value").text == "a<b\nc"
