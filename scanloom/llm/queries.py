"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.best_fit_packing import best_fit_packing
from scanloom.llm.chat_formatting import preference_pairs, swapped_answers
from scanloom.llm.jaccard_join import jaccard_join
from scanloom.llm.lm_scoring import lm_scoring
from scanloom.llm.merkle import merkle_manifest
from scanloom.llm.mixing import domain_of_labels, mix
from scanloom.llm.positional_index import decontamination
from scanloom.llm.quality_classifier import quality_classifier
from scanloom.llm.quality_rules import quality_rules
from scanloom.llm.sharding import reshard_documents
from scanloom.llm.spelling_variants import spelling_variants
from scanloom.llm.token_counts import token_counts
from scanloom.llm.topk_search import topk_search

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", domain_of_labels().alias("domain"))
    return mix(table(spark, folder, "documents"), labels, {"good": 0.94, "low": 0.04, "toxic": 0.02})


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return preference_pairs(turns, swapped_answers(turns))


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join(table(spark, folder, "documents"), n=4, num=85, den=100)


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return reshard_documents(table(spark, folder, "documents"))


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring(table(spark, folder, "documents"), inner=True)


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit_packing(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk_search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest(table(spark, folder, "documents")).drop("copied")


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL_CHAT = """WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
said AS (SELECT conv_id, max(turn) AS last, arg_max(text, turn) AS other FROM t WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT t.conv_id, t.turn, t.role, CASE WHEN t.role = 'assistant' AND t.turn = s.last THEN coalesce(o.other, '') ELSE t.text END AS text
  FROM t LEFT JOIN said s ON s.conv_id = t.conv_id LEFT JOIN said o ON o.conv_id = xor(t.conv_id, 1)),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM r),
n AS (SELECT a.conv_id, coalesce(min(a.i) FILTER (WHERE a.role <> b.role OR a.text <> b.text) - 1, count(*)) AS n
  FROM a JOIN b ON a.conv_id = b.conv_id AND a.i = b.i GROUP BY a.conv_id),
both_sides AS (SELECT 'a' AS side, * FROM a UNION ALL SELECT 'b', * FROM b),
line AS (SELECT side, conv_id, i, n, role, length(text) + 1 AS said, '<|' || role || '|>' || chr(10) || text || chr(10) AS s
  FROM both_sides JOIN n USING (conv_id)),
place AS (SELECT *, sum(CASE WHEN i > n THEN length(s) ELSE 0 END) OVER (PARTITION BY side, conv_id ORDER BY i) - said AS since FROM line)
SELECT conv_id, any_value(n)::INTEGER AS n_prefix,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE side = 'a' AND i <= n), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE side = 'a' AND i > n), '') AS chosen,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE side = 'b' AND i > n), '') AS rejected,
  coalesce(string_agg(since::BIGINT || ':' || said, ' ' ORDER BY i) FILTER (WHERE side = 'a' AND i > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(since::BIGINT || ':' || said, ' ' ORDER BY i) FILTER (WHERE side = 'b' AND i > n AND role = 'assistant'), '') AS rejected_mask
FROM place GROUP BY conv_id"""

SQL_TOPK = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _framed(*values: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values) + ")"


#: Unsigned crc32 of a short ASCII text: eight shifts a byte.
CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
SQL_CRC = f"""crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: {CRC_STEP})), 4294967295) AS h
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL))"""


def _merkle_levels(name: str, levels: int) -> tuple[str, str]:
    """SQL of a tree's levels above ``{name}0(k, pos, h)``, and of the way up, for leaves in ``{name}w0(k, place, node, proof, ...)``."""
    up, way = [], []
    for i in range(levels):
        up.append(f"""{name}g{i} AS MATERIALIZED (SELECT k, pos // 8 AS pos, list(h ORDER BY pos) AS hs, sum(count(*)) OVER (PARTITION BY k) > 1 AS more FROM {name}{i} GROUP BY k, pos // 8),
{name}{i + 1} AS MATERIALIZED (SELECT k, pos, CASE WHEN more THEN sha256(list_aggregate(hs, 'string_agg', '')) ELSE hs[1] END AS h FROM
  (SELECT k, pos, hs, more OR len(hs) > 1 AS more FROM {name}g{i}))""")
        left, right = "array_to_string(hs[1:place % 8], '')", "array_to_string(hs[place % 8 + 2:], '')"
        way.append(f"""{name}w{i + 1} AS MATERIALIZED (SELECT w.* REPLACE (place // 8 AS place, CASE WHEN more OR len(hs) > 1 THEN sha256({left} || node || {right}) ELSE node END AS node,
  proof || CASE WHEN more OR len(hs) > 1 THEN {left} || {right} ELSE '' END AS proof) FROM {name}w{i} w JOIN {name}g{i} g ON g.k = w.k AND g.pos = w.place // 8)""")
    return ",\n".join(up), ",\n".join(way)


(_UP, _WAY), (_CROWN, _ROUND) = _merkle_levels("t", 7), _merkle_levels("c", 3)
SQL_MERKLE = f"""WITH {SQL_CRC},
leaf AS MATERIALIZED (SELECT d.doc_id, coalesce('=' || lang, '-') AS k, {_framed("d.doc_id", "source", "lang", "n_chars", "text")} AS h,
  CASE WHEN crc.h % 3 = 0 THEN {_framed("d.doc_id", "source", "lang", "n_chars", LOWERED)} END AS forged
  FROM documents d LEFT JOIN crc ON crc.doc_id = d.doc_id),
t0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaf),
{_UP},
sub AS MATERIALIZED (SELECT k AS lang, h, row_number() OVER (ORDER BY k) - 1 AS pos FROM t7),
c0 AS (SELECT '' AS k, pos, h FROM sub),
{_CROWN},
tw0 AS (SELECT doc_id, h AS leaf, k, pos AS place, coalesce(forged, h) AS node, '' AS proof FROM t0),
{_WAY},
cw0 AS (SELECT w.doc_id, w.leaf, sub.h AS subroot, '' AS k, sub.pos AS place, w.node, w.proof FROM tw7 w JOIN sub ON sub.lang = w.k),
{_ROUND}
SELECT doc_id, leaf, subroot, c3.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = c3.h AS verified FROM cw3, c3"""

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL_DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({LOWERED}, '{WORDS}'), []) AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all({LOWERED}, '{WORDS}') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1:s + n], ' ') AS t
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(greatest(1, len(w) - 9))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, s, array_to_string(w[s + 1:s + n], ' ') AS t FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.s, dw.n, win.item_id FROM dw JOIN win ON win.n = dw.n AND win.t = dw.t),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
it AS (SELECT r, list(DISTINCT item_id::VARCHAR ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)"""

QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_sharding": op6_sharding,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_token_counts": op8_token_counts,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_topk_search": op10_topk_search,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_decontamination": op13_decontamination,
}
ORACLES: dict[str, str] = {
    "op4_chat_formatting": SQL_CHAT, "op10_topk_search": SQL_TOPK, "op12_merkle_manifest": SQL_MERKLE, "op13_decontamination": SQL_DECONTAMINATION,
}
