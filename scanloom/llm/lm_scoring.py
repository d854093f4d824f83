"""Hashed maximum-entropy language model with n-gram and skip features and a class-factored softmax."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import HASHES, fold, mixed  # noqa: F401
from scanloom.session import settle

END = "\n"  # the end token; no word has white space
ALPHA = 0.1
ROWS = 1 << 14  # hashed feature rows
BLOCK = 256  # feature rows that travel together
SINGLES = 16  # the most frequent tokens are classes of their own
SUFFIXES = 32  # the others are classed by a hash of their last two characters
CLASSES = SINGLES + SUFFIXES
OWN = CLASSES // 2  # the most frequent tokens of a class are members of their own, the others share the members after them
HEAD = 300_000  # most frequent tokens that every task holds
SAFE = 80  # e to this power, and one over it, are well inside 32-bit floats
START = np.array([xxhash.xxh3_64_intdigest(b"start"), xxhash.xxh3_64_intdigest(b"before")], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


GROUP = 4 << 20  # bytes of text that are taken apart at a time


def chunked(column: pa.Array, size: int = GROUP):
    """(start, length) of runs of texts of about ``size`` bytes."""
    cuts = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(column), 0), pa.int64())).to_numpy() // size
    at = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), len(column)]
    return [(lo, hi - lo) for lo, hi in zip(at, at[1:]) if hi > lo]


def split_words(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words per text, and all words with their distinct ones numbered by Arrow; ``words_of`` for a column."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    words = lists.flatten()
    there = pc.greater(pc.binary_length(words), 0)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    before = np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False)))
    return np.diff(before[offsets - offsets[0]]), words.filter(there).dictionary_encode()


def suffix_class(word: bytes) -> int:
    return SINGLES + zlib.crc32(word.decode()[-2:].encode()) % SUFFIXES


def shared_member(word: bytes) -> int:
    return OWN + zlib.crc32(word) % (CLASSES - OWN)


def class_column(word: Column, singles: list[str]) -> Column:
    """The class of a token, as ``suffix_class`` has it."""
    suffix = F.lit(SINGLES) + F.crc32(F.when(F.length(word) > 2, F.substring(word, -2, 2)).otherwise(word).cast("binary")) % SUFFIXES
    out = suffix
    for k, s in enumerate(singles):
        out = F.when(word == s, k).otherwise(out)
    return out.cast("int")


def counted(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(word, c) of all tokens of ``docs``, ends included; a task adds up before it sends, in tables of ``most`` words."""
    def run(batches):
        table: dict[str, int] = {}
        ends = 0

        def rows():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())], names=["word", "c"]
            )

        for batch in batches:
            for lo, n in chunked(batch.column("text")):
                _, words = split_words(batch.column("text").slice(lo, n))
                seen = np.bincount(words.indices.to_numpy(zero_copy_only=False), minlength=len(words.dictionary))
                distinct = words.dictionary.to_pylist()
                before = map(table.get, distinct, repeat(0))
                table.update(zip(distinct, [c + n for c, n in zip(seen.tolist(), before)]))
                ends += n
                if len(table) >= most:
                    yield from rows()
                    table.clear()
        if ends:
            table[END] = ends
        if table:
            yield from rows()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Tables:
    """What every task holds: the head of the vocabulary, and sums over all of it. Bounded by ``HEAD`` and ``CLASSES``."""

    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    train_tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_distinct: np.ndarray
    members: np.ndarray | None = None  # the head's members of their classes, if the features act inside classes
    leaf_tokens: np.ndarray | None = None  # by class and member
    leaf_distinct: np.ndarray | None = None

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ALPHA) / (self.train_tokens + ALPHA * (self.distinct + 1)))

    def within(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log10 P(token | class), or given class and member; what is not known shares one more token's worth."""
        tokens, distinct = (self.class_tokens, self.class_distinct) if self.members is None else (self.leaf_tokens, self.leaf_distinct)
        return np.log10((c + ALPHA) / (tokens[k] + ALPHA * (distinct[k] + 1)))


@dataclass
class Read:
    """A run of texts, token after token: ``starts`` has each text's first place; its end token comes last."""

    starts: np.ndarray
    ids: np.ndarray  # head positions, -1 outside the head
    classes: np.ndarray
    f: np.ndarray  # feature rows
    nth: np.ndarray  # numbers in ``words``
    words: list[str]
    members: np.ndarray | None = None

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.ids)))

    @property
    def leaves(self) -> np.ndarray:
        """What a token's own probability is taken within: its class, or class and member."""
        return self.classes if self.members is None else self.classes * CLASSES + self.members


class Reader:
    """Columns of texts as head positions, classes and feature rows; each distinct word of a run is looked up once."""

    def __init__(self, t: Tables):
        self.at = {w.decode(): i for i, w in enumerate(t.words)}
        self.tables = t

    def read(self, column: pa.Array) -> Read:
        count, words = split_words(column)
        distinct = [*words.dictionary.to_pylist(), END]
        get = self.at.get
        ids = np.fromiter((get(w, -1) for w in distinct), np.int64, len(distinct))
        raw = [w.encode() for w in distinct]
        new = np.flatnonzero(ids < 0)
        crcs = lambda words: np.fromiter(map(zlib.crc32, words), np.int64, len(new))
        classes = np.append(self.tables.classes, 0)[ids]
        classes[new] = SINGLES + crcs([distinct[i][-2:].encode() for i in new.tolist()]) % SUFFIXES  # suffix_class
        members = None
        if self.tables.members is not None:
            members = np.append(self.tables.members, 0)[ids]
            members[new] = OWN + crcs([raw[i] for i in new.tolist()]) % (CLASSES - OWN)  # shared_member
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
        sizes = count + 1
        starts = np.cumsum(sizes) - sizes
        nth = np.full(int(sizes.sum()), len(distinct) - 1, np.int64)
        inside = np.ones(len(nth), bool)
        inside[starts + count] = False
        nth[inside] = words.indices.to_numpy(zero_copy_only=False)
        return Read(starts, ids[nth], classes[nth], run_features(hashes[nth], starts, sizes), nth, distinct, None if members is None else members[nth])


def features(hashes: np.ndarray) -> np.ndarray:
    """Feature rows of each position: the word before, the one before that (a skip) and both together.

    ``hashes`` are those of a text's words; the end has features too.
    """
    one = np.append(START[0], hashes)
    return feature_rows(one, np.append(START, hashes)[: len(one)])


def run_features(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same for texts one after another, each with a place for its end."""
    one, two = np.roll(hashes, 1), np.roll(hashes, 2)
    one[starts] = two[starts] = START[0]
    two[starts[sizes > 1] + 1] = START[1]
    return feature_rows(one, two)


def feature_rows(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    parts = (mixed(one ^ np.uint64(1)), mixed(two ^ np.uint64(2)), mixed(one * np.uint64(0x9E3779B97F4A7C15) + mixed(two)))
    return np.stack([(p % np.uint64(ROWS)).astype(np.int64) for p in parts], 1)


def inner_features(f: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Rows of the weights inside classes: each feature together with the class, and the class alone."""
    out = np.empty((len(f), f.shape[1] + 1), np.int64)
    out[:, :-1] = mixed((f + (classes * ROWS)[:, None]).astype(np.uint64)) % np.uint64(ROWS)
    out[:, -1] = ROWS + classes
    return out


INNER = ROWS + CLASSES + 1  # rows of the weights inside classes; they follow those of the classes


def inside(classes: np.ndarray) -> np.ndarray:
    """Places of tokens whose class has other tokens."""
    return np.flatnonzero(classes >= SINGLES)


def log_tokens(weights: np.ndarray, f: np.ndarray, classes: np.ndarray, members: np.ndarray | None) -> np.ndarray:
    """Natural log of P(class | features), or of P(class | features) P(member | class, features), of each token."""
    out = log_chosen(weights[: ROWS + 1], f, classes)
    if members is not None:
        at = inside(classes)
        out[at] += log_chosen(weights[ROWS + 1 :], inner_features(f[at], classes[at]), members[at])
    return out


_LAST: list[Reader] = []


def reader(shared: Broadcast) -> Reader:
    """The Python worker's reader, made anew for another vocabulary."""
    if not _LAST or _LAST[0].tables is not shared.value:
        _LAST[:] = [Reader(shared.value)]
    return _LAST[0]


def exponents(weights: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Sums of the features' weights, a row per token, safe to exponentiate; the last weight row is the bias."""
    x = weights.take(f[:, 0], axis=0)
    for j in range(1, f.shape[1]):
        x += weights.take(f[:, j], axis=0)
    x += weights[-1]
    if len(x) and not -SAFE < x.min() <= x.max() < SAFE:
        x -= x.max(1, keepdims=True)
    return x


def log_classes(weights: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Natural log of P(class | features), a row per token."""
    x = exponents(weights, f)
    x -= np.log(np.exp(x).sum(1, keepdims=True))
    return x


def log_chosen(weights: np.ndarray, f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``log_classes`` of one class ``y`` per token."""
    x = exponents(weights, f)
    own = x[np.arange(len(y)), y].astype(np.float64)
    return own - np.log(np.exp(x, out=x).sum(1))


def run_sums(g: np.ndarray, which: np.ndarray, edges: np.ndarray, counts: np.ndarray, few: int = 6) -> np.ndarray:
    """Sums of the rows ``which`` of ``g`` in runs that start at ``edges``: most are short, and are added place by place."""
    out = g.take(which[edges], axis=0)
    at = np.arange(len(edges))
    for j in range(1, few):
        at = at[counts[at] > j]
        out[at] += g.take(which[edges[at] + j], axis=0)
    at = at[counts[at] > few]
    if len(at):
        size = counts[at] - few
        start = np.cumsum(size) - size
        rest = np.repeat(edges[at] + few - start, size) + np.arange(size.sum())
        out[at] += np.add.reduceat(g.take(which[rest], axis=0), start, axis=0)
    return out


def descend(weights: np.ndarray, squares: np.ndarray, f: np.ndarray, y: np.ndarray, rate: float, seen: np.ndarray, turn: int = 0) -> None:
    """One step of gradient descent on a batch: the bias and the rows of all three feature groups.

    A row moves by its summed gradient over the root of its summed squares so far. One sort serves all groups; ``turn``,
    the number of the step, chooses nothing.
    """
    g = exponents(weights, f)
    np.exp(g, out=g)
    g /= g.sum(1, keepdims=True)
    g[np.arange(len(y)), y] -= 1
    groups = f.T.ravel().astype(np.uint16)  # row numbers are below 2^16, which numpy sorts by radix
    order = np.argsort(groups, kind="stable")
    rows = groups[order]
    edges = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    counts = np.diff(np.append(edges, len(rows)))
    sums = run_sums(g, order % len(y), edges, counts)
    at = rows[edges].astype(np.int64)
    seen[at] += counts
    moved = squares[at] + np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
    squares[at] = moved
    sums *= (rate / np.sqrt(moved + 1))[:, None]
    weights[at] -= sums
    total = g.sum(0)
    seen[-1] += len(y)
    squares[-1] += (total**2).mean()
    weights[-1] -= rate * total / math.sqrt(squares[-1] + 1)


def trained(docs: DataFrame, tables: Broadcast, weights: np.ndarray, rate: float = 0.5, batch_tokens: int = 8_192) -> np.ndarray:
    """Weights after one pass over ``docs``: every task descends from ``weights`` on its own texts, then rows are averaged
    by how often each task saw them. What a task sends is bounded by the model's size; sums are taken as they arrive."""
    spark = docs.sparkSession
    start = spark.sparkContext.broadcast(weights)
    schema = "block int, seen binary, total binary"
    rows = len(weights)
    padded = -(-rows // BLOCK) * BLOCK

    def run(batches):
        w, seen = start.value.copy(), np.zeros(rows, np.float64)
        squares = np.zeros(rows, np.float32)
        fs, ys, ms, size = [], [], [], 0

        def step(f, y, m):
            outer, inner = slice(0, ROWS + 1), slice(ROWS + 1, rows)
            descend(w[outer], squares[outer], f, y, rate, seen[outer])
            if rows > ROWS + 1:
                at = inside(y)
                if len(at):
                    descend(w[inner], squares[inner], inner_features(f[at], y[at]), m[at], rate, seen[inner])

        for batch in batches:
            column = batch.column("text")
            for lo, n in chunked(column):
                read = reader(tables).read(column.slice(lo, n))
                # Whole texts up to a batch's tokens make a step.
                ends = np.append(read.starts[1:], len(read.ids))
                first = 0
                while first < len(read.ids):
                    last = int(ends[min(int(np.searchsorted(ends, first + batch_tokens - size)), len(ends) - 1)])
                    fs.append(read.f[first:last])
                    ys.append(read.classes[first:last])
                    ms.append(ys[-1] if read.members is None else read.members[first:last])
                    size += last - first
                    first = last
                    if size >= batch_tokens:
                        whole = [np.concatenate(x) for x in (fs, ys, ms)]
                        for i in range(0, size, 2 * batch_tokens):
                            step(*(x[i : i + 2 * batch_tokens] for x in whole))
                        fs, ys, ms, size = [], [], [], 0
        if size:
            step(*(np.concatenate(x) for x in (fs, ys, ms)))
        if seen.any():
            yield from blocks(seen, w * seen[:, None].astype(np.float32))

    def add(batches):
        seen, total, any_row = np.zeros(padded), {}, False
        for batch in batches:
            for k, s, t in zip(*(c.to_pylist() for c in batch.columns)):
                seen[k * BLOCK : (k + 1) * BLOCK] += np.frombuffer(s, np.float64)
                t = np.frombuffer(t, np.float32).astype(np.float64)
                total[k] = total[k] + t if k in total else t
                any_row = True
        if any_row:
            for k, t in total.items():
                yield row(k, seen[k * BLOCK : (k + 1) * BLOCK], t)

    def row(k, s, t):
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s.tobytes()], pa.binary()), pa.array([t.astype(np.float32).tobytes()], pa.binary())], names=["block", "seen", "total"])

    def blocks(seen, total):
        s, t = np.zeros(padded), np.zeros((padded, CLASSES), np.float32)
        s[:rows], t[:rows] = seen, total
        for k in range(padded // BLOCK):
            a = slice(k * BLOCK, (k + 1) * BLOCK)
            if s[a].any():
                yield row(k, s[a], t[a])

    out = weights.copy()
    sent = docs.select("text").mapInArrow(run, schema)
    for k, s, t in sent.repartition("block").mapInArrow(add, schema).collect():  # the model itself, once
        s, t = np.frombuffer(bytes(s), np.float64), np.frombuffer(bytes(t), np.float32).reshape(BLOCK, CLASSES)
        n = min(BLOCK, rows - k * BLOCK)
        known = np.flatnonzero(s[:n] > 0)
        out[k * BLOCK + known] = (t[known] / s[known][:, None]).astype(np.float32)
    start.unpersist()
    return out


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, word string, k int, n long"


def scored(docs: DataFrame, tables: Broadcast, weights: np.ndarray, chunk: int = 16_384) -> DataFrame:
    """One pass over the texts: a row per document with what the head and the classes give, and a row per document and
    word outside the head (``word``, its class, or class and member, ``k``, how often ``n``)."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.int64()]
    schema = pa.schema(list(zip([x.split()[0] for x in SCORED.split(", ")], types)))

    def run(batches):
        part, at = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            t, w, column = tables.value, model.value, batch.column("text")
            for lo, n in chunked(column):
                read = reader(tables).read(column.slice(lo, n))
                log = np.empty(len(read.ids))
                for i in range(0, len(log), chunk):
                    own = slice(i, i + chunk)
                    log[own] = log_tokens(w, read.f[own], read.classes[own], None if read.members is None else read.members[own])
                known = read.ids >= 0
                c = t.counts[read.ids] if len(t.counts) else np.zeros(len(known))
                per = lambda x: np.add.reduceat(np.where(known, x, 0), read.starts)
                model_score = np.add.reduceat(log, read.starts) / math.log(10) + per(t.within(c, read.leaves))
                uid = part + at + np.arange(n)
                at += n
                none = pa.nulls(n, pa.int64())
                own = [uid, batch.column("doc_id").slice(lo, n), batch.column("held_out").slice(lo, n), read.sizes, per(np.ones(len(known), np.int64)),
                       per(t.base(c)), model_score, pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), none]
                yield batch_of(own)
                rest = np.flatnonzero(~known)
                if len(rest):
                    doc = np.searchsorted(read.starts, rest, side="right") - 1
                    key, times = np.unique(doc * len(read.words) + read.nth[rest], return_counts=True)
                    word = key % len(read.words)
                    classes = np.zeros(len(read.words), np.int32)
                    classes[read.nth[rest]] = read.leaves[rest]
                    m = len(key)
                    empty = [pa.nulls(m, ty) for ty in types[1:7]]
                    yield batch_of([uid[key // len(read.words)], *empty, pa.array(read.words).take(pa.array(word)), classes[word], times])

    def batch_of(columns):
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, ty) for c, ty in zip(columns, types)], schema=schema)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, SCORED)


def top_singles(vocabulary: DataFrame) -> list[str]:
    """The most frequent tokens."""
    return [r["word"] for r in vocabulary.orderBy(F.desc("c"), "word").limit(SINGLES).collect()]


def with_members(t: Tables, classed: DataFrame) -> None:
    """Adds the members of the head's tokens, and the sums of each class and member over all of the vocabulary ``classed``."""
    member = np.array([shared_member(w) for w in t.words], np.int64)
    shared, own = t.classes * CLASSES + member, []
    taken = np.zeros(CLASSES, np.int64)
    for i in sorted(range(len(t.words)), key=lambda i: (-t.counts[i], t.words[i])):
        k = t.classes[i]
        if taken[k] < OWN:
            member[i] = taken[k]
            taken[k] += 1
            own.append(i)
    tokens, distinct = (np.zeros(CLASSES * CLASSES, np.int64) for _ in range(2))
    m = F.lit(OWN) + F.crc32(F.col("word").cast("binary")) % (CLASSES - OWN)
    for r in classed.groupBy("k", m.cast("int").alias("m")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["k"] * CLASSES + r["m"]], distinct[r["k"] * CLASSES + r["m"]] = r["n"], r["v"]
    for i in own:  # these leave the member they would share
        at, c = t.classes[i] * CLASSES + member[i], t.counts[i]
        tokens[shared[i]] -= c
        distinct[shared[i]] -= 1
        tokens[at], distinct[at] = c, 1
    t.members, t.leaf_tokens, t.leaf_distinct = member, tokens, distinct


def lm_scoring(docs: DataFrame, folds: int = 10, rounds: int = 2, head: int = HEAD, inner: bool = False) -> DataFrame:
    """Unigram and maximum-entropy log10 probabilities of every document.

    ``docs`` needs doc_id and text; other columns are ignored. Rows whose crc32(doc_id) is 0 modulo ``folds`` are held
    out, all others teach the counts and the weights, each document in one of ``rounds`` rounds. Returns per input row
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. NULL texts count as empty and have the end
    token alone; NULL ids count as the empty text, which is held out; repeated rows count and are scored one by one; without training rows every
    token is unknown; an empty table gives an empty result.

    The model: P(token | history) = P(class | history) P(token | class). The class softmax has weights for hashed
    features of the two words before; within a class, probabilities are smoothed frequencies. With ``inner`` the features
    act inside classes too: P(token | class, history) = P(member | class, history) P(token | member), where the members' softmax has
    weights for the same features together with the class; the ``OWN`` most frequent tokens of a class are members of their own, the
    others share as many by a hash, and only tokens that share a member are told apart by smoothed frequencies. The ``head`` most frequent
    tokens are looked up in the tasks; others meet their counts in a join. So no step holds the vocabulary.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("held_out", fold("doc_id", folds) == 0)
    learn = rows.where(~F.col("held_out"))
    vocabulary = settle(counted(learn))
    top = top_singles(vocabulary)
    classed = vocabulary.withColumn("k", class_column(F.col("word"), top))
    per_class = classed.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    tokens, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in per_class:
        tokens[r["k"]], distinct[r["k"]] = r["n"], r["v"]
    # The least count that keeps the head within its bound.
    steps = vocabulary.groupBy(F.least("c", F.lit(10_000)).alias("c")).agg(F.count("*").alias("n")).collect()
    cut, held = 10_001, 0
    for c, n in sorted(((r["c"], r["n"]) for r in steps), reverse=True):
        if held + n > head:
            break
        cut, held = c, held + n
    frequent = F.col("c") >= cut if cut <= 10_000 else F.col("c") < 0
    # Ends and single classes are in the head whatever the cut.
    first = classed.where(frequent | F.col("word").isin(*top, END)).toArrow()
    tables = Tables(
        [w.encode() for w in first.column("word").to_pylist()], first.column("c").to_numpy(), first.column("k").to_numpy().astype(np.int64),
        int(tokens.sum()), int(distinct.sum()), tokens, distinct,
    )
    if inner:
        with_members(tables, classed)
    shared = spark.sparkContext.broadcast(tables)
    weights = np.zeros((ROWS + 1 + (INNER if inner else 0), CLASSES), np.float32)
    turn = F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds))
    for k in range(rounds):
        weights = trained(learn.where(turn == k), shared, weights, rate=0.5 / (k + 1))
    both = settle(scored(rows, shared, weights))
    tail = both.where("word is not null").select("uid", "word", "k", "n")
    rest = vocabulary.select("word", "c").where(~frequent)
    c = F.coalesce("c", F.lit(0))
    n_tokens, n_distinct = tables.train_tokens, tables.distinct
    of_class = [(int(a), int(b)) for a, b in (zip(tables.leaf_tokens, tables.leaf_distinct) if inner else zip(tokens, distinct))]
    size = F.element_at(F.array(*[F.lit(a + ALPHA * (b + 1)) for a, b in of_class]), F.col("k") + 1)
    looked = tail.join(rest, "word", "left").groupBy("uid").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"),
        F.sum(F.col("n") * F.log10((c + ALPHA) / (n_tokens + ALPHA * (n_distinct + 1)))).alias("tail_base"),
        F.sum(F.col("n") * F.log10((c + ALPHA) / size)).alias("tail_model"),
    )
    own = both.where("word is null")
    return own.join(looked, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("tail_model", F.lit(0.0))).alias("score"),
    )
