"""Queries of de-duplication and archive maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scanloom.functions import tags as G
from scanloom.model import SERIES_EXTRACT
from scanloom.operators import dedup as D
from scanloom.operators import hierarchy as H
from scanloom.operators import stored as S
from scanloom.operators import summaries as U
from scanloom.plans import view as V
from scanloom.plans.registry import query, table
from scanloom.session import drop_shuffles, new_folder, release, settle, settle_bucketed

KEYS = ["study_uid", "series_uid", "sop_uid"]


def datasets(spark, folder, *columns):
    """Every instance as a full dataset, patient and study header included; ``columns`` of the instance beside it."""
    rows = V.instances_in_studies(spark, folder)
    ds = G.dataset({
        "SOPInstanceUID": F.col("sop_uid"),
        "StudyDate": F.col("study_date"),
        "ContentDate": F.col("content_date"),
        "AccessionNumber": F.col("accession"),
        "Modality": F.col("modality"),
        "StudyDescription": F.col("description"),
        "PatientName": F.col("patient_name"),
        "PatientID": F.col("patient_id"),
        "StudyInstanceUID": F.col("study_uid"),
        "SeriesInstanceUID": F.col("series_uid"),
        "SeriesNumber": F.col("series_number").cast("string"),
        "InstanceNumber": F.col("instance_number").cast("string"),
        "NumberOfFrames": F.col("n_frames").cast("string"),
        "Rows": F.col("part_key").cast("string"),
    })
    return rows.select(*KEYS, *columns, ds.alias("ds"))


def line(code, vr, value):
    return f"'{code}=R:{vr}=V1:+' || {value}"


def lines(*parts):
    return " || chr(10) || ".join(line(*p) for p in parts)


PATIENT = lines(("00100010", "PN", "patient_name"), ("00100020", "LO", "patient_id"))
STUDY = lines(("00080020", "DA", "study_date"), ("00080050", "SH", "accession"), ("00081030", "LO", "description"),
              ("0020000D", "UI", "study_uid"))
SERIES = lines(("00080060", "CS", "modality"), ("0020000E", "UI", "series_uid"), ("00200011", "IS", "series_number"))
IMAGE = lines(("00080023", "DA", "content_date"), ("00280010", "US", "part_key"))
OWN = lines(("00080018", "UI", "sop_uid"), ("0020000E", "UI", "series_uid"), ("00200013", "IS", "instance_number"),
            ("00280008", "IS", "n_frames"))
FULL = lines(
    ("00080018", "UI", "sop_uid"), ("00080020", "DA", "study_date"), ("00080023", "DA", "content_date"),
    ("00080050", "SH", "accession"), ("00080060", "CS", "modality"), ("00081030", "LO", "description"),
    ("00100010", "PN", "patient_name"), ("00100020", "LO", "patient_id"), ("0020000D", "UI", "study_uid"),
    ("0020000E", "UI", "series_uid"), ("00200011", "IS", "series_number"), ("00200013", "IS", "instance_number"),
    ("00280008", "IS", "n_frames"), ("00280010", "US", "part_key"),
)
NO_IMAGE = lines(
    ("00080018", "UI", "sop_uid"), ("00080020", "DA", "study_date"), ("00080050", "SH", "accession"),
    ("00080060", "CS", "modality"), ("00081030", "LO", "description"), ("00100010", "PN", "patient_name"),
    ("00100020", "LO", "patient_id"), ("0020000D", "UI", "study_uid"), ("0020000E", "UI", "series_uid"),
    ("00200011", "IS", "series_number"), ("00200013", "IS", "instance_number"), ("00280008", "IS", "n_frames"),
)

SQL_PARTS = f"""WITH {V.SQL_INSTANCES},{V.SQL_STUDIES},
full_rows AS (SELECT * FROM instances JOIN studies USING (study_uid)),
parts AS (SELECT study_uid, series_uid, sop_uid, sha256({PATIENT}) AS patient, sha256({STUDY}) AS study,
                 sha256({SERIES}) AS series, sha256({IMAGE}) AS image, sha256({OWN}) AS own FROM full_rows),
refs AS (SELECT *, sha256(own || chr(10) || patient || chr(10) || study || chr(10) || series || chr(10) || image) AS hash
         FROM parts)"""


def sql_set_hash(col):
    words = [f"CAST('0x' || substr({col}, {at}, 8) AS BIGINT)" for at in range(1, 65, 8)]
    parts = " || ':' || ".join([f"bit_xor({w})" for w in words] + [f"sum({w})" for w in words])
    return f"sha256(count({col}) || ':' || {parts})"


@query("deduplicate", f"""{SQL_PARTS}
SELECT DISTINCT patient AS hash, 'patient' AS type, 2 AS n_tags FROM refs
UNION SELECT study, 'study', 4 FROM refs UNION SELECT series, 'series', 3 FROM refs
UNION SELECT image, 'image', 2 FROM refs""")
def deduplicate(spark, folder):
    extracts, _ = D.deduplicate(datasets(spark, folder))
    return extracts.select("hash", "type", F.size("ds").alias("n_tags"))


@query("deduplicate_references", f"""{SQL_PARTS}
SELECT sop_uid, patient || ',' || study || ',' || series || ',' || image AS refs, hash, 4 AS n_tags FROM refs""")
def deduplicate_references(spark, folder):
    _, inst = D.deduplicate(datasets(spark, folder))
    return inst.select("sop_uid", F.array_join("refs", ",").alias("refs"), "hash", F.size("ds").alias("n_tags"))


@query("recombine", f"""{SQL_PARTS}
SELECT sop_uid, CASE WHEN image < '1' THEN {NO_IMAGE} ELSE {FULL} END AS content,
  (CASE WHEN image < '1' THEN 1 ELSE 0 END)::BIGINT AS missing_refs
FROM full_rows JOIN (SELECT sop_uid, image FROM refs) USING (sop_uid)""")
def recombine(spark, folder):
    """Some image extracts are lost: those datasets come back without them and say so. Both tables lie in the same buckets."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = S.staged_store(D.split_extracts(S.by_cell(datasets(spark, folder), buckets)), buckets, placed=True)
    back = S.recombine_stored(store.without({"image": F.col("hash") < "1"}), KEYS)
    return back.select("sop_uid", G.canonical_text(F.col("ds")).alias("content"), "missing_refs")


@query("recombine_global", f"""{SQL_PARTS}
SELECT sop_uid, CASE WHEN image < '1' THEN {NO_IMAGE} ELSE {FULL} END AS content,
  (CASE WHEN image < '1' THEN 1 ELSE 0 END)::BIGINT AS missing_refs
FROM full_rows JOIN (SELECT sop_uid, image FROM refs) USING (sop_uid)""")
def recombine_global(spark, folder):
    """The same with extracts that are shared by the whole archive and lie anywhere."""
    # Both results come from one pass, as they would from the stored archive.
    split = settle(D.split_extracts(datasets(spark, folder)), "zstd")
    drop_shuffles(spark)
    extracts, inst = settle(D.extracts_of(split), "zstd"), D.references_of(split)
    drop_shuffles(spark)
    back = D.recombine(inst, extracts.where("type <> 'image' OR hash >= '1'"), KEYS)
    release(extracts)  # its pieces are written
    return back.select("sop_uid", G.canonical_text(F.col("ds")).alias("content"), "missing_refs")


@query("stored_deduplicate", f"""{SQL_PARTS}
SELECT study_uid, count(DISTINCT patient) + count(DISTINCT study) + count(DISTINCT series) + count(DISTINCT image) AS n_extracts,
  count(*) AS n_instances FROM refs GROUP BY study_uid""")
def stored_deduplicate(spark, folder):
    """The store written as tables, studies of more than five instances in slices; distinct extracts per study read from it."""
    counts = V.newest_lines(spark, folder).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_instances"))
    studies = counts.select(F.concat(F.lit("1.2."), V.text("l_orderkey")).alias("study_uid"), "n_instances")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = S.by_cell(datasets(spark, folder), buckets, S.hot_studies(studies, 5))
    store = S.write_store(D.split_extracts(rows), buckets, placed=True)
    home = store.refs.groupBy("cell", "study_uid").agg(F.count(F.lit(1)).alias("n"))
    stored = store.extracts.select("cell", "type", F.unhex("hash").alias("hash")).join(home.select("cell", "study_uid"), "cell")
    distinct = stored.select("study_uid", "type", "hash").distinct().groupBy("study_uid").agg(F.count(F.lit(1)).alias("n_extracts"))
    return distinct.join(home.groupBy("study_uid").agg(F.sum("n").alias("n_instances")), "study_uid")


@query("set_hash", f"""WITH m AS (SELECT o_custkey, sha256(o_orderstatus) AS h FROM orders),
twice AS (SELECT o_custkey, h FROM m UNION ALL SELECT o_custkey, h FROM m)
SELECT o_custkey, {sql_set_hash("h")} AS once, (SELECT {sql_set_hash("t.h")} FROM twice t WHERE t.o_custkey = m.o_custkey) AS twice
FROM m GROUP BY o_custkey""")
def set_hash(spark, folder):
    """Repeated members do not cancel: a set and the same set with every member twice differ, as do two such multisets."""
    m = table(spark, folder, "orders").select("o_custkey", F.sha2(F.col("o_orderstatus"), 256).alias("h"))
    once = m.groupBy("o_custkey").agg(D.set_hash(F.col("h")).alias("once"))
    return once.join(m.union(m).groupBy("o_custkey").agg(D.set_hash(F.col("h")).alias("twice")), "o_custkey")


@query("extractors", f"""WITH {V.SQL_INSTANCES},
p AS (SELECT sop_uid, sha256({SERIES}) AS series, sha256({line("00280010", "US", "part_key")} ) AS pixel
      FROM instances WHERE study_uid IN (SELECT '1.2.' || o_orderkey FROM orders))
SELECT series AS hash, 'series' AS type, count(*) AS n FROM p GROUP BY series
UNION ALL SELECT pixel, 'pixel', count(*) FROM p GROUP BY pixel""")
def extractors(spark, folder):
    """De-duplication with other tag sets than the default ones."""
    sets = {"series": SERIES_EXTRACT, "pixel": ["Rows", "Columns"]}
    split = D.split_extracts(datasets(spark, folder), sets)
    used = split.select(F.explode_outer("parts").alias("p")).select("p.hash", "p.type")
    return used.groupBy("hash", "type").agg(F.count(F.lit(1)).alias("n"))


@query("dedup_stats", f"""{SQL_PARTS}
SELECT study_uid, count(*) AS n_instances, {sql_set_hash("hash")} AS info_hash,
       count(DISTINCT patient) + count(DISTINCT study) + count(DISTINCT series) + count(DISTINCT image) AS n_extracts,
       count(DISTINCT patient) AS n_patient, count(DISTINCT study) AS n_study, count(DISTINCT series) AS n_series,
       count(DISTINCT image) AS n_image FROM refs GROUP BY study_uid""")
def dedup_stats(spark, folder):
    _, inst = D.deduplicate(datasets(spark, folder))
    # Rows come from the join by study and stay where they are, so what is counted per study is not moved again.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inst = settle_bucketed(inst.select("study_uid", "refs", "hash"), ["study_uid"], buckets, placed=True)
    drop_shuffles(spark)
    return D.dedup_stats(D.extracts_used(inst), inst)


@query("new_instances_only", """
WITH old AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'),
fresh AS (SELECT * FROM lineitem l WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND NOT EXISTS (
  SELECT 1 FROM old WHERE old.l_orderkey = l.l_orderkey AND old.l_linenumber = l.l_linenumber))
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM fresh
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_suppkey, l_partkey, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) = 1""")
def new_instances_only(spark, folder):
    li = V.arrivals(spark, folder)
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    keys = ["l_orderkey", "l_linenumber"]
    existing = li.where(F.col("l_shipdate") < cut).select(*keys)
    out = D.new_instances(li.where(F.col("l_shipdate") >= cut), existing, keys, V.VERSION)
    return out.select(*keys, "l_suppkey", "l_partkey")


def order_files(spark, folder):
    """Per-object files of a study: here the orders of a customer."""
    o = table(spark, folder, "orders")
    return o.select(
        F.concat(F.lit("1.2."), V.text("o_custkey")).alias("study_uid"),
        F.sha2(V.text("o_orderkey"), 256).alias("file_hash"),
        F.col("o_orderstatus").alias("status"),
    )


def order_group(spark, folder):
    read = order_files(spark, folder).where("status = 'F'")
    group = D.group_log(read.withColumnRenamed("file_hash", "hash"))
    return group, D.group_refs(group, read)


SQL_FILES = f"""
files AS (SELECT '1.2.' || o_custkey AS study_uid, sha256(CAST(o_orderkey AS VARCHAR)) AS file_hash,
                 o_orderstatus AS status FROM orders),
grp AS (SELECT study_uid, {sql_set_hash("file_hash")} AS file_hash, count(*) AS n_instances
        FROM files WHERE status = 'F' GROUP BY study_uid)"""


@query("group_log", f"""WITH {SQL_FILES}
SELECT g.study_uid, g.file_hash, g.n_instances, n.n_files FROM grp g
JOIN (SELECT study_uid, count(*) AS n_files FROM files GROUP BY study_uid HAVING count(*) > 1) n USING (study_uid)""")
def group_log(spark, folder):
    files = order_files(spark, folder)
    read = files.where("status = 'F'").withColumnRenamed("file_hash", "hash")
    return D.group_log(read, files).drop("n_new")


@query("unreferenced_files", f"""WITH {SQL_FILES}
SELECT study_uid, file_hash, status FROM files WHERE status <> 'F'
UNION ALL SELECT study_uid, file_hash, 'group' FROM grp""")
def unreferenced_files(spark, folder):
    group, refs = order_group(spark, folder)
    files = order_files(spark, folder).unionByName(
        group.select("study_uid", "file_hash", F.lit("group").alias("status"))
    )
    return D.unreferenced_files(files, refs)


@query("gc_referenced", f"""WITH {SQL_FILES}
SELECT study_uid, count(*) AS n_files, count(*) FILTER (status = 'F') AS n_deletable, bool_and(status = 'F') AS removable
FROM files GROUP BY study_uid""")
def gc_referenced(spark, folder):
    _, refs = order_group(spark, folder)
    return D.removable_folders(order_files(spark, folder), refs)


@query("gc_deletable_files", f"WITH {SQL_FILES} SELECT study_uid, file_hash, status FROM files WHERE status = 'F'")
def gc_deletable_files(spark, folder):
    _, refs = order_group(spark, folder)
    return D.deletable_files(order_files(spark, folder), refs)


CHAINS_SQL = """
f AS (SELECT '1.2.' || o_custkey AS study_uid, sha256(CAST(o_orderkey AS VARCHAR)) AS file_hash, epoch_us(o_orderdate) AS mtime, o_orderkey AS k,
             o_orderstatus <> 'P' AS there, o_custkey FROM orders),
ordered AS (SELECT *, lag(file_hash) OVER w AS before, row_number() OVER w AS i,
             last_value(file_hash) OVER (PARTITION BY o_custkey ORDER BY mtime, file_hash ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS later
             FROM f WINDOW w AS (PARTITION BY o_custkey ORDER BY mtime, file_hash)),
refs AS (SELECT study_uid, file_hash, before AS ref FROM ordered WHERE before IS NOT NULL AND i % 6 <> 0
         UNION SELECT study_uid, file_hash, later FROM ordered WHERE i % 6 = 1 AND k % 3 = 0 AND later <> file_hash)"""


@query("reference_chains", f"""WITH RECURSIVE {CHAINS_SQL},
reach AS (SELECT study_uid, file_hash AS src, mtime, file_hash AS node FROM f WHERE there
          UNION SELECT r.study_uid, r.src, r.mtime, refs.ref FROM reach r JOIN refs ON refs.study_uid = r.study_uid AND refs.file_hash = r.node),
best AS (SELECT study_uid, node, max((mtime, src)) AS label FROM reach GROUP BY study_uid, node)
SELECT f.study_uid, f.file_hash, label[2] AS by, label > (f.mtime, f.file_hash) AS superseded FROM f JOIN best ON best.study_uid = f.study_uid AND best.node = f.file_hash
WHERE there""")
def reference_chains(spark, folder):
    """Files that replace the one before them, five in a row, some closed to a circle, some of them gone."""
    o = table(spark, folder, "orders")
    mtime = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    files = o.select(
        F.concat(F.lit("1.2."), V.text("o_custkey")).alias("study_uid"), F.sha2(V.text("o_orderkey"), 256).alias("file_hash"), mtime.alias("mtime"),
        F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") != "P").alias("there"),
    )
    along = Window.partitionBy("study_uid").orderBy("mtime", "file_hash")
    last = F.last("file_hash").over(along.rowsBetween(0, 4))
    ordered = files.select("*", F.lag("file_hash").over(along).alias("before"), F.row_number().over(along).alias("i"), last.alias("later"))
    # Both kinds of references come from one pass over the ordered files.
    chain = F.when(F.expr("before IS NOT NULL AND i % 6 <> 0"), F.col("before"))
    circle = F.when(F.expr("i % 6 = 1 AND k % 3 = 0 AND later <> file_hash"), F.col("later"))
    refs = ordered.select("study_uid", "file_hash", F.explode(F.array_compact(F.array(chain, circle))).alias("ref"))
    present = files.where("there").select("study_uid", "file_hash", "mtime")
    return D.newest_superseders(present, refs).drop("mtime")


@query("metadata_dirty", f"""WITH {SQL_FILES},
log AS (SELECT study_uid, count(*) FILTER (status = 'O') AS n_new, count(*) FILTER (status = 'P') AS n_files,
               {sql_set_hash("file_hash")} AS file_hash FROM files GROUP BY study_uid),
idx AS (SELECT study_uid, {sql_set_hash("file_hash")} AS content_hash FROM files WHERE status <> 'O' GROUP BY study_uid)
SELECT study_uid, n_new, n_files, n_new > 0 OR n_files > 1 OR file_hash IS DISTINCT FROM content_hash AS dirty
FROM log LEFT JOIN idx USING (study_uid)""")
def metadata_dirty(spark, folder):
    files = order_files(spark, folder)
    log = files.groupBy("study_uid").agg(
        F.count_if(F.col("status") == "O").alias("n_new"),
        F.count_if(F.col("status") == "P").alias("n_files"),
        D.set_hash(F.col("file_hash")).alias("file_hash"),
    )
    index = files.where("status <> 'O'").groupBy("study_uid").agg(D.set_hash(F.col("file_hash")).alias("content_hash"))
    return D.metadata_dirty(log, index).select("study_uid", "n_new", "n_files", "dirty")


@query("reject", f"""WITH {V.SQL_INSTANCES},
gone AS (SELECT DISTINCT series_uid FROM instances WHERE content_date >= '20010101')
SELECT sop_uid, series_uid, CASE WHEN series_uid IN (SELECT series_uid FROM gone) OR n_frames >= 49 THEN 'deleted'
  ELSE 'instance' END AS type FROM instances""")
def reject(spark, folder):
    inst = V.instances(spark, folder).select(*KEYS, "content_date", "n_frames", F.lit("instance").alias("type"))
    series = inst.where("content_date >= '20010101'").select("study_uid", "series_uid", F.lit(None).cast("string").alias("sop_uid"))
    single = inst.where("n_frames >= 49").select(*KEYS)
    return D.reject(inst, series.unionByName(single)).select("sop_uid", "series_uid", "type")


@query("rejected_summary", f"""WITH {V.SQL_INSTANCES},
gone AS (SELECT DISTINCT series_uid FROM instances WHERE content_date >= '20010101')
SELECT study_uid, series_uid, min(series_number) AS series_number, arg_min(modality, instance_number) AS modality,
       count(*) AS n_instances FROM instances WHERE series_uid NOT IN (SELECT series_uid FROM gone)
GROUP BY study_uid, series_uid""")
def rejected_summary(spark, folder):
    inst = V.instances(spark, folder).withColumn("type", F.lit("instance"))
    series = inst.where("content_date >= '20010101'").select("study_uid", "series_uid", F.lit(None).cast("string").alias("sop_uid"))
    return H.series_summary(D.live(D.reject(inst, series)), V.INSTANCE_COLUMNS)


@query("attribute_update", f"""{SQL_PARTS},
new_patient AS (SELECT DISTINCT patient, sha256('new' || patient) AS replacement FROM refs JOIN full_rows USING (sop_uid)
                WHERE full_rows.description = 'BUILDING')
SELECT sop_uid, coalesce(replacement, refs.patient) || ',' || study || ',' || series || ',' || image AS refs
FROM refs LEFT JOIN new_patient ON refs.patient = new_patient.patient WHERE sop_uid NOT LIKE '%7' AND sop_uid NOT LIKE '%8'
UNION ALL SELECT sop_uid, '' FROM refs WHERE sop_uid LIKE '%7' UNION ALL SELECT sop_uid, NULL FROM refs WHERE sop_uid LIKE '%8'""")
def attribute_update(spark, folder):
    """Instances without refs, empty or NULL, stay as they are."""
    data = datasets(spark, folder)
    _, inst = D.deduplicate(data)
    kept = F.when(F.col("sop_uid").endswith("7"), F.array().cast("array<string>")).when(~F.col("sop_uid").endswith("8"), F.col("refs"))
    # The update reads its instances twice, so the hashes are computed once, here.
    inst = settle(inst.select(*KEYS, kept.alias("refs")), "zstd")
    drop_shuffles(spark)
    building = data.where(G.get_value(F.col("ds"), "StudyDescription") == "BUILDING")
    old = D.split_extracts(building).select(F.get("parts", F.lit(0))["hash"].alias("old_hash")).distinct()
    # Every hash is replaced twice, and the later replacement counts.
    swaps = old.withColumn("at", F.explode(F.array(F.lit(1), F.lit(2))))
    swaps = swaps.withColumn("new_hash", F.sha2(F.concat(F.when(F.col("at") == 2, "new").otherwise("older"), "old_hash"), 256))
    out = D.update_attributes(inst, swaps, KEYS)
    return out.select("sop_uid", F.array_join("refs", ",").alias("refs"))


@query("split_study", f"""WITH {V.SQL_INSTANCES},
m AS (SELECT *, series_uid IN (SELECT series_uid FROM instances WHERE content_date >= '20010101') AS hit FROM instances)
SELECT study_uid, series_uid, sop_uid, 'instance' AS type FROM m WHERE NOT hit
UNION ALL SELECT study_uid, series_uid, sop_uid, 'deleted' FROM m WHERE hit
UNION ALL SELECT study_uid || '.2', series_uid, sop_uid, 'instance' FROM m WHERE hit""")
def split_study(spark, folder):
    inst = V.instances(spark, folder)
    moved = inst.where("content_date >= '20010101'").select("study_uid", "series_uid")
    rows = inst.select(*KEYS, F.lit("instance").alias("type"))
    return D.split_study(rows, moved, F.concat("study_uid", F.lit(".2")))




def described(spark, folder):
    """Instances with their hierarchy columns and their full dataset."""
    # One pass over the instances; rows whose keys are not all known are none.
    return datasets(spark, folder, "series_number", "instance_number", "modality").dropna(subset=KEYS)


def sql_json(*fields):
    return "'{' || " + " || ',' || ".join(f"""'"{code}":{{"vr":"{vr}","Value":["' || {value} || '"]}}'""" for code, vr, value in fields) + " || '}'"


SERIES_JSON = sql_json(("00080060", "CS", "modality"), ("0020000D", "UI", "study_uid"), ("0020000E", "UI", "series_uid"),
                       ("00200011", "IS", "series_number"), ("00201209", "IS", "n_instances"))
STUDY_JSON = sql_json(("00080020", "DA", "study_date"), ("00080050", "SH", "accession"),
                      ("00080061", "CS", "replace(modalities, ',', chr(34) || ',' || chr(34))"), ("00081030", "LO", "description"),
                      ("00100010", "PN", "patient_name"), ("00100020", "LO", "patient_id"), ("0020000D", "UI", "study_uid"),
                      ("00201206", "IS", "n_series"), ("00201208", "IS", "n_instances"))
INSTANCE_JSON = sql_json(("00080018", "UI", "sop_uid"), ("00080023", "DA", "content_date"), ("0020000D", "UI", "study_uid"),
                         ("0020000E", "UI", "series_uid"), ("00200013", "IS", "instance_number"), ("00280010", "US", "part_key"))
SQL_DOCUMENTS = f"""WITH {V.SQL_INSTANCES},{V.SQL_STUDIES},
inner_rows AS (SELECT instances.* FROM instances JOIN studies USING (study_uid)),
series AS (SELECT study_uid, series_uid, min(series_number) AS series_number, arg_min(modality, instance_number) AS modality,
  count(*) AS n_instances FROM inner_rows GROUP BY study_uid, series_uid),{V.SQL_STUDY_ROWS}"""


@query("series_documents", f"""{SQL_DOCUMENTS}
SELECT series_uid, {SERIES_JSON} AS document FROM series""")
def series_documents(spark, folder):
    return U.series_documents(described(spark, folder)).select("series_uid", U.document_text(F.col("ds")).alias("document"))


@query("study_documents", f"""{SQL_DOCUMENTS}
SELECT study_uid, {STUDY_JSON} AS document FROM study_rows JOIN studies USING (study_uid)""")
def study_documents(spark, folder):
    inst = described(spark, folder)
    return U.study_documents(inst, U.series_documents(inst)).select("study_uid", U.document_text(F.col("ds")).alias("document"))


@query("archive_documents", f"""{SQL_DOCUMENTS}
SELECT 'study' AS kind, 'studies/' || study_uid AS path, {STUDY_JSON} AS document FROM study_rows JOIN studies USING (study_uid)
UNION ALL SELECT 'series', 'studies/' || study_uid || '/series/' || series_uid, {SERIES_JSON} FROM series
UNION ALL SELECT 'instance', 'studies/' || study_uid || '/series/' || series_uid || '/instances/' || sop_uid, {INSTANCE_JSON} FROM inner_rows""")
def archive_documents(spark, folder):
    """Written as an archive folder and read back."""
    path = new_folder(spark, "documents")
    # Instances come from the join by study and stay where they are: series and studies are made inside the buckets.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = settle_bucketed(described(spark, folder), ["study_uid"], buckets, placed=True)
    drop_shuffles(spark)
    with S.joined_in_place(spark):
        U.write_documents(U.archive_documents(rows), path)
    release(rows)
    return spark.read.parquet(path).select("kind", "path", "document")
