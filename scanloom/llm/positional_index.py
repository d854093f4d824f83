"""Positional inverted index of the training texts; exact phrase and proximity matches of test texts.

DataFrame functions only. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.session import new_folder, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
#: Candidate documents (8 bytes each) that are sent to every executor; beyond, the filter is a shuffled join.
SENT = 1_000_000


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; NULL has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text.cast("string"), UPPER, LOWER), F.lit(WORD)), F.array().cast("array<string>"))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings ``(term, row, pos)`` of every word of every text, written once, without a shuffle.

    Every task's files are a shard of the documents whose postings lie in the order of the terms, each term's list by
    document and place. ``row`` numbers the documents. One more posting per document, with a NULL term, carries its
    ``doc_id`` and in ``pos`` its number of words; documents without words have only that one.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), words_of(F.col(text)).alias("w"))
    # The document's own entry comes last in the array, behind the words.
    entries = F.concat("w", F.array(F.lit(None).cast("string")))
    spread = rows.select("doc_id", "row", F.posexplode(entries).alias("pos", "word"))
    there = F.col("word").isNotNull()
    own = spread.select(F.when(there, F.xxhash64("word")).alias("term"), "row", "pos", F.when(~there, F.col("doc_id")).alias("doc_id"))
    path = new_folder(docs.sparkSession, "postings")
    own.sortWithinPartitions("term").write.parquet(path, compression="zstd")
    return docs.sparkSession.read.schema("term long, row long, pos int, doc_id long").parquet(path)


@dataclass
class Queries:
    """Test texts: ``items(item, item_id)``, ``terms(item, at, term, df, size)`` with each word's list length in the index."""

    items: DataFrame
    terms: DataFrame


def read_queries(index: DataFrame, texts: DataFrame, item_id: str = "item_id", text: str = "text") -> Queries:
    """Words of the distinct test texts and the length of each word's list; rows without id or words take no part."""
    plain = texts.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("w")).where("item_id IS NOT NULL")
    items = settle(plain.where(F.size("w") > 0).distinct().withColumn("item", F.monotonically_increasing_id()))
    terms = items.select("item", F.size("w").alias("size"), F.posexplode(F.transform("w", lambda x: F.xxhash64(x))).alias("at", "term"))
    asked = terms.select("term").distinct()
    lists = index.select("term").join(asked, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    counted = settle(terms.join(lists, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))))
    return Queries(items.select("item", "item_id"), counted)


def rarest(queries: Queries, width: int = 10, lists: int = 2) -> DataFrame:
    """``(item, group, at, term, rank)``: the places of the ``lists`` rarest words of every window, each choice once.

    Windows that choose the same places share a group. Windows with a word that the index lacks are left out: they occur
    nowhere. ``rank`` 1 is the rarest. A window of fewer words has fewer places.
    """
    t = queries.terms
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - (width - 1)), F.greatest(F.lit(0), F.least(F.col("at"), F.col("size") - width)))
    inside = t.select("item", "at", "term", "df", F.explode(starts).alias("start"))
    # A window holds at most ``width`` places.
    window = inside.groupBy("item", "start").agg(F.array_sort(F.collect_list(F.struct("df", "at", "term"))).alias("p"))
    held = window.where(F.get("p", F.lit(0))["df"] > 0).select("item", F.slice("p", 1, lists).alias("p")).distinct()
    group = held.select("item", F.xxhash64("item", F.transform("p", lambda x: x["at"])).alias("group"), F.size("p").alias("n"), F.posexplode("p").alias("rank", "x"))
    return group.select("item", "group", "n", F.col("x.at").alias("at"), F.col("x.term").alias("term"), (F.col("rank") + 1).alias("rank"))


def candidates(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(item, row, diagonal)`` where the rarest words of a window all occur at their distances.

    The lists of the chosen words are shifted by the word's place in the test text; equal shifted places in all lists of
    a group are the intersection. A list is read where it lies; only its shifted entries meet, spread over
    (group, document, diagonal).
    """
    shifted = index.where("term IS NOT NULL").select("term", "row", "pos").join(chosen, "term")
    entries = shifted.select("item", "group", "n", "row", (F.col("pos") - F.col("at")).alias("diagonal"), "rank")
    met = entries.groupBy("item", "group", "n", "row", "diagonal").agg(F.count(F.lit(1)).alias("_lists"))
    return met.where(F.col("_lists") == F.col("n")).select("item", "row", "diagonal").distinct()


def _postings_of(index: DataFrame, rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the given documents for the given terms."""
    few = rows.limit(SENT + 1).count() <= SENT
    held = index.where("term IS NOT NULL").select("term", "row", "pos").join(terms.select("term").distinct(), "term", "left_semi")
    return held.join(F.broadcast(rows) if few else rows, "row", "left_semi")


def phrase_matches(index: DataFrame, queries: Queries, width: int = 10) -> DataFrame:
    """``(item, row, start, at, length)``: maximal runs of at least ``width`` words that a test and a training text share.

    ``at`` and ``start`` are the run's first places in the test and the training text. A test text of fewer words matches
    whole. Candidates come from the two rarest lists of every window; then the lists of all the item's other words are
    intersected on the candidate's diagonal.
    """
    found = settle(candidates(index, rarest(queries, width)))
    rows = settle(found.select("row").distinct())
    postings = _postings_of(index, rows, queries.terms)
    due = found.join(queries.terms.select("item", "at", "term", "size"), "item")
    due = due.select("item", "row", "diagonal", "at", "term", "size", (F.col("diagonal") + F.col("at")).alias("pos")).where("pos >= 0")
    hits = due.join(postings, ["row", "pos", "term"])
    along = Window.partitionBy("item", "row", "diagonal").orderBy("at")
    runs = hits.withColumn("_run", F.col("at") - F.row_number().over(along)).groupBy("item", "row", "diagonal", "size", "_run")
    ends = runs.agg(F.min("at").alias("at"), F.count(F.lit(1)).cast("int").alias("length"))
    whole = ends.where(F.col("length") >= F.least(F.lit(width), F.col("size")))
    return whole.select("item", "row", (F.col("diagonal") + F.col("at")).alias("start"), "at", "length")


def proximity_matches(index: DataFrame, queries: Queries, slop: int, width: int = 10, lists: int = 3) -> DataFrame:
    """``(item, at, row, pos)``: places where a window's ``lists`` rarest words stand in other order or with gaps.

    ``at`` is the place of a window's rarest word in the test text, ``pos`` its place in the training text. Each of the
    window's other chosen words occurs in the same document, its distance to the rarest one off by at most ``slop`` from
    that in the test text. Lists meet in buckets of the shifted place, the other words' entries also in the neighbouring
    buckets, so a document with a word very often does not meet itself in full.
    """
    chosen = rarest(queries, width, lists)
    size = slop + 1
    shifted = index.where("term IS NOT NULL").select("term", "row", "pos").join(chosen, "term")
    entries = shifted.select("item", "group", "n", "row", "rank", "at", "pos", (F.col("pos") - F.col("at")).alias("d"))
    entries = entries.withColumn("bucket", F.floor(F.col("d") / size))
    first = entries.where("rank = 1").select("item", "group", "n", "row", "at", "pos", "d", "bucket")
    rest = entries.where("rank > 1").select(
        "group", "row", "rank", F.col("d").alias("_d"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket")
    )
    # Of the entries of a word in a bucket only the next ones on either side matter, so they combine before the join.
    near = rest.groupBy("group", "row", "bucket", "rank").agg(F.collect_set("_d").alias("_ds"))
    met = first.join(near, ["group", "row", "bucket"], "left")
    close = F.exists("_ds", lambda x: F.abs(x - F.col("d")) <= slop)
    counted = met.groupBy("item", "group", "n", "row", "at", "pos").agg(F.count_if(close).alias("_near"))
    return counted.where(F.col("_near") == F.col("n") - 1).select("item", "at", "row", "pos").distinct()


def decontamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Words of ``docs(doc_id, text)`` that lie in a window of ``width`` consecutive words of ``benchmark(item_id, text)``.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``. A test text of fewer
    words is one window, one without words none. ``items_sha256`` is the digest of the ids of the test texts with
    occurring windows, sorted as strings and joined by commas; without any that of the empty text. NULL and empty texts have
    no words. Rows without ids: such a document is reported like any other, such a test text takes no part. Repeated
    documents are reported each, repeated test ids count once. Other columns are ignored; empty tables give no rows or no
    hits.
    """
    index = build_index(docs)
    queries = read_queries(index, benchmark)
    spans = settle(phrase_matches(index, queries, width).select("item", "row", "start", "length"))
    places = spans.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos"))
    hit = places.distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = spans.select("row", "item").distinct().join(queries.items, "item").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    rows = index.where("term IS NULL").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    out = rows.join(hit, "row", "left").join(named, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
