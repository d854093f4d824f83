"""Packing of documents into sequences by bin completion with branch and bound."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.session import settle

MEMO = 1 << 20
GROUP = 8 << 20  # bytes of text that are taken apart at a time


class ChunkIds:
    """Token ids of texts, a column at a time, remembered per chunk between ASCII spaces.

    Right for tokenisers that lower-case, drop white space and never look across it, as ``word_bpe_49k.json``: A-Z may be
    lower-cased first, which leaves fewer chunks, but not in a text that may hold a special token's string. A column is
    split and its distinct chunks numbered by Arrow; only those are looked up, and the ids are then taken by number.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.marks = sorted({t.content.encode()[:2].decode() for t in self.library.get_added_tokens_decoder().values()})
        self.known: dict[str, bytes] = {}

    def chunks(self, texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
        """Bounds of every text's chunks, and the chunks."""
        lowered = pc.ascii_lower(texts)
        for mark in self.marks:
            lowered = pc.if_else(pc.match_substring(texts, mark), texts, lowered)
        lists = pc.ascii_split_whitespace(lowered)
        return lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()

    def look_up(self, words: list[str]) -> list[bytes]:
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > MEMO:
            self.known = {}
            fresh = words
        for i in range(0, len(fresh), 10_000):
            part = fresh[i : i + 10_000]
            for w, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                self.known[w] = np.array(e.ids, "<u4").tobytes()
        return [self.known[w] for w in words]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the texts' bounds among them."""
        bounds, chunks = self.chunks(texts)
        data = self.look_up(chunks.dictionary.to_pylist())
        size = np.fromiter(map(len, data), np.int64, len(data)) // 4
        first = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(data), "<u4")
        nth = chunks.indices.to_numpy(zero_copy_only=False)
        taken = size[nth]
        ends = np.append(0, np.cumsum(taken))
        ids = pool[np.repeat(first[nth] - ends[:-1], taken) + np.arange(ends[-1])] if len(pool) else pool
        return ids, ends[bounds - bounds[0]] if len(bounds) else np.zeros(1, np.int64)


@cache
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("part", pa.int32()), ("nth", pa.int64()),
])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; ``nth`` numbers the pieces of one length in a task, ``part``.

    A document is its token ids and then ``end_id``; only longer ones than ``capacity`` are cut. The numbers are fixed
    when the result is written, as :func:`best_fit_packing` does.
    """
    end = np.array([end_id], "<u4")
    close = end.tobytes()

    def run(batches):
        ids, part, seen = chunk_ids(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            cuts = pc.cumulative_sum(pc.cast(pc.binary_length(texts), pa.int64())).to_numpy() // GROUP
            at = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(at, at[1:]):
                if hi > lo:
                    yield cut(*ids.of(texts.slice(lo, hi - lo)), batch.column("doc_id").slice(lo, hi - lo), part, seen)

    def cut(ids, bounds, doc_ids, part, seen):
        size = np.diff(bounds) + 1
        count = -(-size // capacity)
        doc = np.repeat(np.arange(len(size)), count)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * capacity
        length = np.minimum(size[doc] - start, capacity)
        sums = np.empty(len(doc), np.int64)
        view = memoryview(np.ascontiguousarray(ids)).cast("B") if len(ids) else memoryview(b"")
        begin = bounds[doc] + start
        last = start + length == size[doc]
        for i, (b, e, ended) in enumerate(zip((begin * 4).tolist(), ((begin + length - last) * 4).tolist(), last.tolist())):
            crc = zlib.crc32(view[b:e])
            sums[i] = zlib.crc32(close, crc) if ended else crc
        # Place among the task's pieces of the same length.
        order = np.argsort(length, kind="stable")
        ranked = length[order]
        edge = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        runs = np.diff(np.append(edge, len(ranked)))
        nth = np.empty(len(ranked), np.int64)
        nth[order] = np.arange(len(ranked)) - np.repeat(edge, runs) + seen[ranked]
        seen[ranked[edge]] += runs
        columns = [doc_ids.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums),
                   pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth)]
        return pa.RecordBatch.from_arrays(columns, schema=PIECES)

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


@dataclass
class Search:
    """Bin completion over counted lengths; ``plan`` is a list of (lengths of a sequence, how many such sequences)."""

    capacity: int
    ends: int = 6_000
    best: int = 1 << 62
    plan: list[tuple[tuple[int, ...], int]] = field(default_factory=list)
    bound: int = 0
    proven: bool = True

    def run(self, counts: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
        have = np.zeros(self.capacity + 1, np.int64)
        for length, n in counts.items():
            have[length] = n
        self.total = int((have * np.arange(self.capacity + 1)).sum())
        self.bound = self.lower(have)
        self.keep(self.best_fit(have.copy()))
        if self.best > self.bound:
            self.left = self.ends
            self.branch(have)
        return self.plan

    def keep(self, plan: list[tuple[tuple[int, ...], int]]) -> None:
        n = sum(k for _, k in plan)
        if n < self.best:
            self.best, self.plan = n, list(plan)

    def lower(self, have: np.ndarray) -> int:
        """Sequences that any packing needs: by volume with the large pieces' unavoidable waste, for each threshold."""
        c, half = self.capacity, self.capacity // 2
        volume, number = np.cumsum(have * np.arange(c + 1)), np.cumsum(have)
        k = np.arange(half + 1)
        big = number[-1] - number[c - k]
        mid_n, mid_v = number[c - k] - number[half], volume[c - k] - volume[half]
        small = volume[half] - np.where(k > 0, volume[np.maximum(k - 1, 0)], 0)
        over = -(-(small - (mid_n * c - mid_v)) // c)
        return int(max(-(-int(volume[-1]) // c), (big + mid_n + np.maximum(0, over)).max()))

    def best_fit(self, have: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
        """Best-fit decreasing over counts: the sequence with the least room that still takes the piece."""
        room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(self.capacity + 1)]
        for length in range(self.capacity, 0, -1):
            n, space = int(have[length]), length
            while n:
                while space <= self.capacity and not room[space]:
                    space += 1
                if space > self.capacity:
                    per = self.capacity // length
                    whole, rest = divmod(n, per)
                    for k, m in ((per, whole), (rest, 1)):
                        if k and m:
                            room[self.capacity - k * length].append(((length,) * k, m))
                    break
                held, m = room[space].pop()
                k = min(space // length, n)
                take = min(m, n // k)
                if take < m:
                    room[space].append((held, m - take))
                room[space - k * length].append((held + (length,) * k, take))
                n -= k * take
        return [x for r in room for x in r]

    def exact(self, have: np.ndarray, first: int) -> Iterator[tuple[int, ...]]:
        """Completions of a sequence that holds ``first`` by up to three further pieces without any room left, larger pieces first."""
        space = self.capacity - first
        if space == 0:
            yield ()
            return
        here = have[: space + 1] > 0

        def usable(x: tuple[int, ...]) -> bool:
            return all(have[length] >= n for length, n in Counter((first, *x)).items())

        if here[space] and usable((space,)):
            yield (space,)
        pairs = np.flatnonzero(here[1:space] & here[space - 1 : 0 : -1]) + 1
        for a in pairs[pairs * 2 >= space][::-1].tolist():
            if usable((a, space - a)):
                yield a, space - a
        for a in np.flatnonzero(here[: space - 1])[::-1].tolist():
            rest = space - a
            top = here[: rest + 1]
            pairs = np.flatnonzero(top[1:rest] & top[rest - 1 : 0 : -1]) + 1
            for b in pairs[(pairs * 2 >= rest) & (pairs <= a)][::-1].tolist():
                if usable((a, b, rest - b)):
                    yield a, b, rest - b

    def maximal(self, have: np.ndarray, first: int) -> Iterator[tuple[int, ...]]:
        """All completions that leave no room for a further piece, larger pieces first.

        A length that is passed over although it fits must not fit at the end; a branch whose smaller pieces cannot use the
        room up that far is not entered.
        """
        space = self.capacity - first
        lengths = np.flatnonzero(have[: space + 1])[::-1].tolist()
        counts = [int(have[x]) - (x == first) for x in lengths]
        tail = [0] * (len(lengths) + 1)
        for i in range(len(lengths) - 1, -1, -1):
            tail[i] = tail[i + 1] + lengths[i] * counts[i]

        def walk(room: int, i: int, need: int) -> Iterator[tuple[int, ...]]:
            while i < len(lengths) and (lengths[i] > room or not counts[i]):
                i += 1
            if i == len(lengths):
                if room < need:
                    yield ()
                return
            while i < len(lengths) and room - tail[i] < need:
                x = lengths[i]
                most = min(counts[i], room // x) if x <= room else 0
                for n in range(most, 0, -1):
                    below = need if n == most else min(need, x)
                    left = room - n * x
                    if left - tail[i + 1] < below:
                        for more in walk(left, i + 1, below):
                            yield (x,) * n + more
                if most:
                    need = min(need, x)
                i += 1

        yield from walk(space, 0, space + 1)

    def dominated(self, have: np.ndarray, first: int, filling: tuple[int, ...]) -> bool:
        """Another piece could stand for one smaller piece of the filling, or for several of its pieces, within the room.

        Those pieces would fit where the other one goes, so the exchange costs nothing and the filling need not be tried.
        """
        room = self.capacity - first - sum(filling)
        used = Counter((first, *filling))
        one = several = 0
        for x in filling:
            several |= (several << x) | (one << x)
            one |= 1 << x
        there = self.bits(have)
        for x, n in used.items():
            if have[x] == n:
                there &= ~(1 << x)
        larger = widened(one << 1, room - 1) if room else 0
        return bool((widened(several, room) | larger) & there)

    def bits(self, have: np.ndarray) -> int:
        return int.from_bytes(np.packbits(have > 0, bitorder="little").tobytes(), "little")

    def options(self, have: np.ndarray, first: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Undominated fillings for the largest piece, exact ones first, each as often as it lasts and then less often."""
        seen: dict[tuple[int, ...], int] = {}
        for source in (self.exact, self.maximal):
            for x in source(have, first):
                lens = (first, *x)
                if lens in seen:
                    continue
                if self.dominated(have, first, x):
                    self.left -= 1
                    if self.left <= 0:
                        return
                    continue
                seen[lens] = min(int(have[length]) // n for length, n in Counter(lens).items())
                yield lens, seen[lens]
        for lens, most in seen.items():
            for k in range(most - 1, 0, -1):
                yield lens, k

    def branch(self, have: np.ndarray) -> None:
        """Depth first, without recursion; a node is a choice of filling for the largest piece left.

        A branch ends when its waste so far cannot beat the incumbent, when nothing is left, or when a filling is dominated.
        Only ended branches are bounded, ``ends`` of them; ``proven`` tells that the search ran out before, or met the lower
        bound, so that the incumbent is the optimum.
        """
        state, plan = have.copy(), []
        stack: list[list] = []  # options, what is applied, waste before it
        waste, descend = 0, True
        while self.left > 0 and self.best > self.bound:
            if descend:
                lengths = np.flatnonzero(state)
                if len(lengths):
                    stack.append([self.options(state, int(lengths[-1])), None, waste])
                else:
                    self.keep(plan)
                    self.left -= 1
            if not stack:
                break
            top = stack[-1]
            if top[1] is not None:
                lens, k = top[1]
                for length in lens:
                    state[length] += k
                plan.pop()
                top[1], waste = None, top[2]
            step = next(top[0], None)
            if step is None:
                stack.pop()
                descend = False
                if not stack:
                    break
                continue
            lens, k = step
            for length in lens:
                state[length] -= k
            plan.append(step)
            top[1] = step
            waste = top[2] + k * (self.capacity - sum(lens))
            descend = waste + self.total <= (self.best - 1) * self.capacity
            self.left -= not descend
        self.proven = self.best <= self.bound or self.left > 0


def widened(bits: int, by: int) -> int:
    """Every set bit and the ``by`` bits above it."""
    done = 0
    while bits and done < by:
        step = min(done + 1, by - done)
        bits |= bits << step
        done += step
    return bits


def plan_packing(counts: dict[int, int], capacity: int, ends: int = 6_000) -> list[tuple[tuple[int, ...], int]]:
    """Sequences, as (lengths, number of such sequences), that hold ``counts`` pieces of each length."""
    return Search(capacity, ends).run(counts)


def pack(rows: DataFrame, capacity: int = 4096, ends: int = 6_000) -> DataFrame:
    """Adds sequence_id and offset to rows with ``length``, ``part`` and ``nth`` (numbers the pieces of one length in one part).

    Pieces of one length are interchangeable, so the search sees only how many there are of each (``capacity`` numbers,
    however large the input) and its plan hands out ranks within a length. A rank is ``nth`` plus the number of such
    pieces in earlier parts, so no task numbers the pieces of a length.
    """
    spark = rows.sparkSession
    sizes = settle(rows.groupBy("length", "part").agg(F.count("*").alias("n")))
    lengths = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("length", "part", before.alias("before"))
    # Ranges of ranks: length, first rank, copies per sequence, first sequence, place of the first copy.
    used: Counter = Counter()
    base, ranges = 0, []
    for lens, k in plan_packing(lengths, capacity, ends):
        at = 0
        for length, n in Counter(lens).items():
            ranges.append((length, used[length], n, base, at))
            used[length] += n * k
            at += n * length
        base += k
    table = np.array(sorted(ranges), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)  # about as many rows as the plan has steps, a few for each length
    ranked = rows.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "part", "nth")

    def run(batches):
        ranges = shared.value
        keys = (ranges[:, 0] << 44) + ranges[:, 1]
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(np.int64), pdf.pop("rank").to_numpy(np.int64)
            r = ranges[np.searchsorted(keys, (length << 44) + rank, side="right") - 1] if len(pdf) else ranges[:0]
            nth = rank - r[:, 1]
            yield pdf.assign(sequence_id=r[:, 3] + nth // np.maximum(r[:, 2], 1), offset=r[:, 4] + nth % np.maximum(r[:, 2], 1) * length)

    out = ranked.drop("rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return ranked.select(*out.columns, "rank").mapInPandas(run, schema + ", sequence_id bigint, offset bigint")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, ends: int = 6_000) -> DataFrame:
    """All documents packed into as few sequences of at most ``capacity`` tokens as the search finds.

    ``docs`` needs doc_id and text; other columns are ignored. Returns per piece doc_id, piece, start, length,
    ids_crc32, sequence_id and offset. NULL texts count as empty: their one piece is ``end_id`` alone. Repeated rows
    and NULL ids are packed like any other row; an empty table gives an empty result.

    One pass over the texts writes the pieces; everything after works on them.
    """
    return pack(settle(pieces(docs, tokenizer, capacity, end_id)), capacity, ends)
