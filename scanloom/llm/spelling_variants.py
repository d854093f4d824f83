"""Spelling variants: words one edit apart, found with pivotal bigrams, grouped under their most frequent form."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.session import settle

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
LETTERS = "A-Za-zÀ-ÿ"
#: A word's prefix: its 2 * 1 + 1 rarest bigrams, among which two are always disjoint; one edit makes 2 new bigrams.
PREFIX, NEW = 3, 2
#: Shorter words have no two disjoint bigrams among three; they have no near words.
SHORTEST = 4
#: Letters that the keys of a batch of words carry.
BATCH = 1 << 22
#: Letters of a cut segment, at least, and cuts of one side, at most.
SEGMENT, CUTS = 3, 16
#: A chain of forms grows by a factor at every step, so a 64-bit count bounds it: 19 links for 10, 2 ** 6 hops.
HOPS = 6


def document_words(docs: DataFrame, shortest: int = 7, deleted: int = 31, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)``: the letter runs of every whole text with their number of occurrences, counted map-side first.

    Runs are lower-cased in A-Z only. Where ``deleted`` divides the checksum h of ``<doc_id>:<run>``, the run loses its
    code point h modulo its length. Words of fewer than ``shortest`` code points are left out. A NULL text has no words,
    a NULL id counts as the empty text; repeated rows count each.
    """
    low = F.translate(F.col(text).cast("string"), UPPER, LOWER)
    # A run of too few letters cannot become a word; whole runs match because the pattern is greedy.
    runs = F.regexp_extract_all(low, F.lit(f"([{LETTERS}]{{{shortest},}})"))
    own = F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("own")
    rows = docs.select(own, runs.alias("runs")).select("own", F.explode("runs").alias("run"))
    h = F.crc32(F.concat("own", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % deleted == 0, cut).otherwise(F.col("run"))
    words = rows.select("run", h.alias("h")).select(word.alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.length("word") >= shortest)


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """Every bigram's place in the order from rare to frequent, by the number of words that hold it.

    Comes to the driver: the pairs of an alphabet, at most 8100 for these letters.
    """
    starts = F.sequence(F.lit(1), F.length("word") - 1)
    grams = F.array_distinct(F.transform(starts, lambda i: F.substr("word", i, F.lit(2))))
    counts = words.select(F.explode(grams).alias("g")).groupBy("g").count().collect()
    return {g: i for i, (_, g) in enumerate(sorted((r["count"], r["g"]) for r in counts))}


def prefix(word: str, ranks: dict[str, int]) -> list[tuple[int, int]]:
    """(rank, place) of the word's rarest bigrams, in order; equal bigrams by place.

    Bigrams equal to the last one follow it, up to ``NEW``: a bigram that both words of a pair keep can be later in the other
    word's order by no more than the bigrams that the edit makes.
    """
    grams = sorted((ranks[word[i : i + 2]], i) for i in range(len(word) - 1))
    return grams[:PREFIX] + [g for g in grams[PREFIX : PREFIX + NEW] if g[0] == grams[PREFIX - 1][0]]


def pivots(grams: list[tuple[int, int]]) -> list[int]:
    """Places of the two disjoint bigrams of the prefix with the least sum of ranks.

    Dynamic programming over the places in order: the best pair that ends at a place is its rank and the best single
    one among the places at least two before.
    """
    by_place = sorted((place, rank) for rank, place in grams[:PREFIX])
    best_one: list[tuple[int, int]] = []  # the best single bigram up to here
    best_pair: tuple[int, int, int] | None = None
    left = 0
    for place, rank in by_place:
        while left < len(by_place) and by_place[left][0] <= place - 2:
            one = (by_place[left][1], by_place[left][0])
            best_one.append(min(best_one[-1], one) if best_one else one)
            left += 1
        if left:
            first = best_one[left - 1]
            pair = (first[0] + rank, first[1], place)
            best_pair = pair if best_pair is None else min(best_pair, pair)
    return list(best_pair[1:])


def segments(size: int) -> list[tuple[int, int]]:
    """Cuts of a side of ``size`` letters; an empty side has one empty cut."""
    width = max(SEGMENT, -(-size // CUTS))
    return [(x, min(x + width, size)) for x in range(0, size, width)] or [(0, 0)]


def _key(side: str, size: int, start: int, kept: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{side}{size}.{start}|{kept}") - (1 << 63)


def index_keys(word: str, grams: list[tuple[int, int]]) -> Iterator[int]:
    """Keys of a word as the other word of a pair: around each prefix bigram, one side with one segment cut out."""
    n = len(word)
    for _, p in grams:
        for x, y in segments(p):
            yield _key("l", p, x, f"{word[:x]}\0{word[y:]}")
        size = n - p - 2
        for x, y in segments(size):
            yield _key("r", size, x, f"{word[: p + 2 + x]}\0{word[p + 2 + y :]}")


def probe_keys(word: str, places: list[int]) -> Iterator[int]:
    """Keys under which words one edit away can lie that still hold one of the pivots.

    The edit lies on one side of the pivot, whose place moves by one at most; the other side is untouched. Of the edited
    side, which is as long as before or one letter longer or shorter, all segments but one are untouched.
    """
    n = len(word)
    for p in places:
        for other in (p - 1, p, p + 1):
            if other < 0:
                continue
            for x, y in segments(other):
                back = other - y  # letters kept after the cut
                if x + back <= p:
                    yield _key("l", other, x, f"{word[:x]}\0{word[p - back :]}")
        size = n - p - 2
        for other in (size - 1, size, size + 1):
            if other < 0:
                continue
            for x, y in segments(other):
                back = other - y
                if x + back <= size:
                    yield _key("r", other, x, f"{word[: p + 2 + x]}\0{word[n - back :]}")


def _keyed(words: DataFrame, ranks: dict[str, int], probe: bool) -> DataFrame:
    """One row ``(key, word, n)`` for every key of every word, in Arrow batches."""
    names = ("key", "asker", "asker_n") if probe else ("key", "other", "other_n")
    types = pa.schema([(names[0], pa.int64()), (names[1], pa.string()), (names[2], pa.int64())])

    def run(batches):
        for batch in batches:
            start, carried, keys, sizes = 0, 0, [], []
            for at, w in enumerate(batch.column(0).to_pylist()):
                grams = prefix(w, ranks)
                found = set(probe_keys(w, pivots(grams)) if probe else index_keys(w, grams))
                keys.extend(found)
                sizes.append(len(found))
                carried += len(found) * len(w)
                if carried > BATCH:
                    yield rows(batch.slice(start, at + 1 - start), keys, sizes)
                    start, carried, keys, sizes = at + 1, 0, [], []
            yield rows(batch.slice(start), keys, sizes)

    def rows(part, keys, sizes):
        at = pa.array(np.repeat(np.arange(part.num_rows), sizes))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), part.column(0).take(at), part.column(1).take(at)], schema=types)

    return words.select("word", "n").mapInArrow(run, f"{names[0]} long, {names[1]} string, {names[2]} long")


def near_pairs(words: DataFrame) -> DataFrame:
    """``(word, word_n, near, near_n)``: all pairs exactly one edit apart, in both directions.

    ``words(word, n)`` has each word once; those under ``SHORTEST`` code points have no pairs. Let s be the word whose last prefix bigram is not more frequent than the
    other's. One edit spoils at most one of s's two disjoint pivots, and the other is in the other word's prefix, with its
    place moved by one at most; so the pair meets under a key of that pivot. A key holds the whole word but one segment of
    about three letters, so words that only share a beginning or an end do not meet. Candidates are verified inside the
    join; every key is a hash, which can add candidates and loses none.
    """
    words = words.where(F.length("word") >= SHORTEST)
    ranks = bigram_ranks(words)
    asked, there = _keyed(words, ranks, True), _keyed(words, ranks, False)
    one = (F.col("asker") != F.col("other")) & (F.levenshtein("asker", "other", 1) == 1)
    met = asked.join(there, "key").where(one)
    swap = F.col("asker") > F.col("other")
    a, b = F.struct(F.col("asker").alias("w"), F.col("asker_n").alias("n")), F.struct(F.col("other").alias("w"), F.col("other_n").alias("n"))
    pairs = met.select(F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b")).distinct()
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    return both.select(F.col("p.a.w").alias("word"), F.col("p.a.n").alias("word_n"), F.col("p.b.w").alias("near"), F.col("p.b.n").alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` of every word with a form, by pointer doubling over ``links(word, form)``.

    Counts grow along a chain, so there is no cycle and HOPS doublings reach the end of any.
    """
    now = settle(links.select("word", F.col("form").alias("root")))
    for _ in range(HOPS):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        hop = now.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        now = settle(hop)
        if now.where("_moved").isEmpty():
            break
        now = now.drop("_moved")
    return now.select("word", "root")


def variant_groups(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Every word with its form and the root of its group: word, form, root, n, n_near, form_n.

    ``words(word, n)`` has each word once, other columns are ignored, rows with a NULL take no part. A word's form is its near
    word (one inserted, deleted or replaced code point) of largest n, ties to the smallest in code-point order, if that n
    is at least ``ratio`` times its own; ``ratio`` must be 2 at least, so that chains end. ``root`` follows the forms to
    the last one. Words without near words have ``n_near`` 0 and are their own root. An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = words.select("word", "n").where("word IS NOT NULL AND n IS NOT NULL")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    takes = -F.col("best.n") >= F.col("n") * ratio
    formed = settle(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(takes, F.col("best.form")).alias("form"), F.when(takes, -F.col("best.n")).alias("form_n"),
        )
    )
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def at_least(col: str, least: int) -> Column:
    return F.col(col) >= least


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, ratio: int = 10) -> DataFrame:
    """Variant groups of the words of ``docs(doc_id, text)`` that occur ``least`` times or more.

    See :func:`document_words` for words, NULLs and repeated rows, :func:`variant_groups` for the result.
    """
    words = settle(document_words(docs, shortest).where(at_least("n", least)))
    return variant_groups(words, ratio)
