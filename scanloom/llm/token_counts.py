"""Exact token counts of every prefix of a text by dynamic programming over a byte-level BPE."""

from __future__ import annotations

import json
from bisect import bisect_left
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import map_columns
from scanloom.session import settle

#: Fixed pattern of the byte-level pre-tokeniser.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
#: Texts with other characters are cut by the library itself, whose character tables may be of another age.
FOREIGN = regex.compile(r"[^\x00-\x1b\x20-\x84\x86-ɏ]")
#: A space that stands alone between other characters opens a chunk; texts with any other space are one chunk.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
CROWDED = f"(?:^|{WHITE}) | (?:$|{WHITE})"
MEMO = 1 << 20
#: Code points of a stored part, and bytes of text that are taken apart at a time.
PART, GROUP = 4096, 4 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts tokens of any prefix.

    A token sequence is what BPE gives exactly if each pair of neighbours is what BPE gives for the pair alone, so the last
    token of every prefix follows from those of shorter prefixes: ``ends`` is that recurrence. Tables are kept per
    distinct piece of the pre-tokeniser, for BPE never crosses pieces.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        special = {x["content"] for x in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.library = Tokenizer.from_file(path)
        self.fitting: dict[tuple[bytes, bytes], bool] = {}
        # The merge that makes each token; plain are files in which a token has one, after those of its parts, and none before it across its parts.
        self.parts = {a + b: (a, b) for a, b in self.ranks}
        self.made = {a + b: r for (a, b), r in self.ranks.items()}
        single = lambda t: len(t) == 1 or t in self.parts
        self.plain = (
            len(self.parts) == len(self.ranks) and all(map(single, self.ids))
            and all(all(single(x) and self.made.get(x, -1) < r for x in pair) for pair, r in self.ranks.items())
            and all(self.apart(a, b, r) for (a, b), r in self.ranks.items())
        )
        self.tables: dict[str, list[int]] = {}
        self.totals: dict[str, int] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """Plain BPE: the lowest-ranked pair first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether BPE leaves ``left`` and ``right`` as they are, side by side."""
        key = (left, right)
        if key not in self.fitting:
            if len(self.fitting) >= MEMO:
                self.fitting.clear()
            if self.plain:
                self.fitting[key] = not left or self.apart(left, right, 1 << 30)
            else:
                self.fitting[key] = self.merge(left + right) == ([left, right] if left else [right])
        return self.fitting[key]

    def apart(self, left: bytes, right: bytes, limit: int) -> bool:
        """Whether BPE makes ``left`` and ``right`` side by side without a merge across them of a rank below ``limit``.

        Their merges are undone, the latest first: a merge across the border must not come before the one undone last.
        """
        ranks, made, parts = self.ranks, self.made, self.parts
        while True:
            rank = ranks.get((left, right))
            if rank is not None and rank < limit:
                return False
            a, b = made.get(left, -1), made.get(right, -1)
            if a > b:
                limit, left = a, parts[left][1]
            elif b >= 0:
                limit, right = b + 1, parts[right][0]  # of equal pairs the left one is merged first
            else:
                return True

    def ends(self, data: bytes) -> list[int]:
        """Token count after each byte of a piece, from 0 on."""
        count, last = [0], [b""]
        self.extend(data, count, last)
        return count

    def extend(self, data: bytes, count: list[int], last: list[bytes]) -> None:
        """Go on from the counts and last tokens of the prefixes that ``count`` and ``last`` hold."""
        have = len(count)
        count += [0] * (len(data) + 1 - have)
        last += [b""] * (len(data) + 1 - have)
        for i in range(have, len(data) + 1):
            for start in range(max(0, i - self.longest), i):
                token = data[start:i]
                if token in self.ids and self.fits(last[start], token):
                    count[i], last[i] = count[start] + 1, token
                    break

    def learn(self, pieces: list[str]) -> None:
        """Totals of pieces, in order, so that a piece goes on from the prefix it shares with the one before."""
        if len(self.totals) + len(pieces) > MEMO:
            self.totals.clear()
        before, count, last = b"", [0], [b""]
        for data, piece in sorted((p.encode(), p) for p in pieces):
            same = 0
            for a, b in zip(before, data):
                if a != b:
                    break
                same += 1
            del count[same + 1 :], last[same + 1 :]
            self.extend(data, count, last)
            self.totals[piece] = count[-1]
            before = data

    def table(self, piece: str) -> list[int]:
        """Token count after each code point of a piece, from 0 on."""
        if piece not in self.tables:
            if len(self.tables) >= MEMO // 8:
                self.tables.clear()
            data = piece.encode()
            got = self.ends(data)
            if len(data) != len(piece):
                got = [got[i] for i in accumulate((len(c.encode()) for c in piece), initial=0)]
            if piece in CONTRACTIONS:  # cut short, it is an apostrophe and a letter
                got = [*range(len(piece)), got[-1]]
            self.tables[piece] = got
        return self.tables[piece]

    def total(self, piece: str) -> int:
        n = self.totals.get(piece)
        if n is None:
            if len(self.totals) >= MEMO:
                self.totals.clear()
            n = self.totals[piece] = self.ends(piece.encode())[-1]
        return n

    def segments(self, text: str) -> list[tuple[int, list[str] | str]]:
        """(place, pieces) of ordinary text and (place, string) of special tokens."""
        out, at = [], 0
        for m in self.special.finditer(text):
            if m.start() > at:
                out.append((at, self.pieces(text[at : m.start()])))
            out.append((m.start(), m.group()))
            at = m.end()
        if at < len(text):
            out.append((at, self.pieces(text[at:])))
        return out

    def pieces(self, text: str) -> list[str]:
        if not FOREIGN.search(text):
            return PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        return sum(1 if isinstance(p, str) else sum(map(self.total, p)) for _, p in self.segments(text))

    def prefixes(self, text: str) -> list[int]:
        """Token count of ``text[:i]`` for every i from 0 to the text's length."""
        out = [0]
        for at, pieces in self.segments(text):
            if isinstance(pieces, str):
                self._special(text, at, pieces, out)
                continue
            base, start = out[at], at
            for piece in pieces:
                table = self.table(piece)
                out.extend(base + n for n in table[1:])
                run = spaces_before(text, start, at)
                if run < start and white(text[start]):
                    out[start + 1] = out[run] + self.table(text[run : start + 1])[-1]
                base += table[-1]
                start += len(piece)
        return out

    def _special(self, text: str, at: int, token: str, out: list[int]) -> None:
        """A special token cut short is ordinary text, which may join what stands before it."""
        low = 0
        for m in self.special.finditer(text, 0, at):
            low = m.end()
        before = out[low]
        for k in range(1, len(token)):
            out.append(before + sum(map(self.total, self.pieces(text[low : at + k]))))
        out.append(out[at] + 1)

    def fit(self, text: str, budget: int) -> int:
        """Length in code points of the longest prefix of at most ``budget`` tokens."""
        segments = self.segments(text)
        if any(isinstance(p, str) for _, p in segments):
            return max(i for i, n in enumerate(self.prefixes(text)) if n <= budget)
        pieces = segments[0][1] if segments else []
        bases = list(accumulate(map(self.total, pieces), initial=0))
        if bases[-1] <= budget:
            return len(text)
        # Every piece costs a token at least, so the end lies before or just inside the first piece that starts at the budget.
        stop = min(len(pieces), bisect_left(bases, budget) + 1)
        starts = list(accumulate(map(len, pieces[:stop]), initial=0))
        for k in range(stop - 1, -1, -1):
            counts = [bases[k] + n for n in self.table(pieces[k])]
            run = spaces_before(text, starts[k], 0)
            if run < starts[k] and white(text[starts[k]]):
                counts[1] = bases[bisect_left(starts, run)] + self.table(text[run : starts[k] + 1])[-1]
            good = [i for i in range(1, len(counts)) if counts[i] <= budget]
            if good:
                return starts[k] + good[-1]
        return 0


def white(c: str) -> bool:
    """White space as the pre-tokeniser's pattern has it."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


def spaces_before(text: str, at: int, low: int) -> int:
    """Start of the run of white space that ends before ``at``.

    A prefix that ends in white space has the whole run as one piece, while the last space before a word belongs to the
    word in a longer text.
    """
    while at > low and white(text[at - 1]):
        at -= 1
    return at


class PrefixColumns:
    """Token counts of all prefixes of a column of texts.

    No piece of the pre-tokeniser goes on behind a space that stands alone, so the count of a prefix is that of the chunks
    before plus that of a prefix of its chunk. Arrow numbers a column's distinct chunks; each has its table once.
    """

    def __init__(self, counter: PrefixCounter):
        self.counter = counter
        self.known: dict[str, bytes] = {}
        self.totals: dict[str, int] = {}

    def tables(self, chunks: list[str]) -> list[bytes]:
        """Counts after each code point of each chunk, as 32-bit numbers."""
        if len(self.known) + len(chunks) > MEMO // 2:
            self.known = {}
        for c in chunks:
            if c not in self.known:
                self.known[c] = np.array(self.counter.prefixes(c)[1:], np.int32).tobytes()
        return [self.known[c] for c in chunks]

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts after each code point of all texts, one text after another, and the texts' bounds."""
        texts = pc.fill_null(column, "")
        crowded = pc.match_substring_regex(texts, CROWDED).to_numpy(zero_copy_only=False)
        plain, bounds = self._plain(texts.filter(pa.array(~crowded)))
        if not crowded.any():
            return plain, bounds
        # Texts with other white space, one by one, between the others.
        odd = iter([np.array(self.counter.prefixes(t)[1:], np.int32) for t in texts.filter(pa.array(crowded)).to_pylist()])
        rest = iter(zip(bounds.tolist(), bounds[1:].tolist()))
        out = [next(odd) if c else plain[slice(*next(rest))] for c in crowded.tolist()]
        return np.concatenate(out), np.append(0, np.cumsum([len(x) for x in out]))

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Bounds of the texts' chunks, the distinct chunks and the number of each chunk among them."""
        lists = pc.split_pattern(texts, " ")
        first = lists.offsets.to_numpy().astype(np.int64)
        first -= first[0]
        words = lists.flatten().dictionary_encode()
        distinct, nth = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        opens = np.zeros(len(nth), bool)
        opens[first[:-1]] = True
        # A word opens its text or comes after a space: a chunk of its own each.
        key = nth * 2 + opens
        used = np.bincount(key, minlength=2 * len(distinct)) > 0
        chunks = [distinct[k // 2] if k % 2 else " " + distinct[k // 2] for k in np.flatnonzero(used).tolist()]
        return first, chunks, (np.cumsum(used) - 1)[key]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        first, chunks, chunk = self._chunks(texts)
        if not len(chunk):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        tables = self.tables(chunks)
        size = np.fromiter(map(len, tables), np.int64, len(tables)) // 4
        pool = np.frombuffer(b"".join(tables), np.int32)
        end = np.cumsum(size)
        total = np.where(size > 0, pool[np.maximum(end - 1, 0)], 0) if len(pool) else np.zeros(len(size), np.int64)
        taken, tokens = size[chunk], total[chunk].astype(np.int64)
        before = np.cumsum(tokens) - tokens
        before -= np.repeat(before[first[:-1]], np.diff(first))
        at = np.append(0, np.cumsum(taken))
        counts = pool[np.repeat((end - size)[chunk] - at[:-1], taken) + np.arange(at[-1])] + np.repeat(before, taken) if at[-1] else np.zeros(0, np.int64)
        return counts.astype(np.int32), at[first]

    def whole(self, column: pa.Array, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of all texts, and the code points of their longest prefixes of at most ``limit`` tokens."""
        texts = pc.fill_null(column, "")
        crowded = pc.match_substring_regex(texts, CROWDED).to_numpy(zero_copy_only=False)
        n, fit = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        n[~crowded], fit[~crowded] = self._whole_plain(texts.filter(pa.array(~crowded)), limit)
        for i, t in zip(np.flatnonzero(crowded).tolist(), texts.filter(pa.array(crowded)).to_pylist()):
            n[i] = self.counter.count(t)
            fit[i] = self.counter.fit(t, limit) if n[i] > limit else len(t)
        return n, fit

    def _whole_plain(self, texts: pa.Array, limit: int) -> tuple[np.ndarray, np.ndarray]:
        first, chunks, chunk = self._chunks(texts)
        totals = np.array(self._totals(chunks), np.int64)
        points = np.fromiter(map(len, chunks), np.int64, len(chunks))
        tokens = np.append(0, np.cumsum(totals[chunk]))
        places = np.append(0, np.cumsum(points[chunk]))
        n, fit = np.diff(tokens[first]), np.diff(places[first])
        for i in np.flatnonzero(n > limit).tolist():
            # Every chunk of a text costs a token at least: the end lies in the last one that starts under the limit.
            lo = int(first[i])
            last = int(np.searchsorted(tokens[lo : first[i + 1]], tokens[lo] + limit)) - 1 + lo
            if last < lo:
                fit[i] = 0
                continue
            inside = np.frombuffer(self.tables([chunks[chunk[last]]])[0], np.int32) + (tokens[last] - tokens[lo])
            good = np.flatnonzero(inside <= limit)
            fit[i] = places[last] - places[lo] + (good[-1] + 1 if len(good) else 0)
        return n, fit

    def _totals(self, chunks: list[str]) -> list[int]:
        if len(self.totals) + len(chunks) > MEMO // 2:
            self.totals = {}
        new = [c for c in chunks if c not in self.totals]
        if new:
            segments = [self.counter.segments(c) for c in new]
            known = self.counter.totals
            self.counter.learn(list({p for s in segments for _, ps in s if not isinstance(ps, str) for p in ps if p not in known}))
            for c, s in zip(new, segments):
                self.totals[c] = sum(1 if isinstance(p, str) else sum(map(self.counter.total, p)) for _, p in s)
        return [self.totals[c] for c in chunks]


@cache
def counter(path: str) -> PrefixCounter:
    """One counter for each Python worker and file."""
    return PrefixCounter(path)


@cache
def columns(path: str) -> PrefixColumns:
    return PrefixColumns(counter(path))


def groups(n_bytes: pa.Array) -> list[tuple[int, int]]:
    """Bounds of runs of texts of about ``GROUP`` bytes."""
    cuts = pc.cumulative_sum(n_bytes).to_numpy() // GROUP
    edges = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), len(n_bytes)]
    return [(lo, hi) for lo, hi in zip(edges, edges[1:]) if hi > lo]


PARTS = (
    "uid long, doc_id long, n_bytes long, part int, base int, last int, lowest int, highest int, counts array<smallint>"
)


def prefix_parts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The prefix table in parts of ``PART`` code points: for every text rows uid, doc_id, n_bytes, part (from 0), base, last, lowest,
    highest, counts.

    ``base + counts[j]`` is the token count of the text's first ``part * PART + j + 1`` code points, ``base`` that of those
    before the part, ``last`` the one at its end, ``lowest`` and ``highest`` bound those inside. A text without
    code points has one part without counts. ``uid`` numbers the texts; it is fixed when the rows are written.
    """
    names = [x.split()[0] for x in PARTS.split(", ")]

    def run(batches):
        own, at = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            for lo, hi in groups(n_bytes):
                counts, bounds = columns(tokenizer).of(texts.slice(lo, hi - lo))
                yield parts(counts, bounds, own + at + np.arange(hi - lo), batch.column("doc_id").slice(lo, hi - lo), n_bytes.slice(lo, hi - lo))
                at += hi - lo

    def parts(counts, bounds, uid, doc_ids, n_bytes):
        size = np.diff(bounds)
        n = np.maximum(1, -(-size // PART))
        doc = np.repeat(np.arange(len(size)), n)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = bounds[doc] + part * PART
        stop = np.minimum(start + PART, bounds[doc + 1])
        full = stop > start
        padded = np.append(counts, 0)  # places past the end belong to empty parts
        base = np.where(part > 0, padded[start - 1], 0)
        last = np.where(full, padded[stop - 1], base)
        lowest, highest = base.copy(), base.copy()
        if full.any():
            lowest[full], highest[full] = (f.reduceat(counts, start[full]) for f in (np.minimum, np.maximum))
        values = (counts - np.repeat(base, stop - start)).astype(np.int16)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(stop - start)), pa.int32()), pa.array(values))
        take = pa.array(doc)
        numbers = [pa.array(x.astype(np.int32)) for x in (part, base, last, lowest, highest)]
        return pa.RecordBatch.from_arrays([pa.array(uid[doc]), doc_ids.take(take), n_bytes.take(take), *numbers, lists], names=names)

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, PARTS)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Token counts of whole texts, and where a text must end to fit ``limit`` tokens.

    ``docs`` needs doc_id and text; other columns are ignored. Returns per input row doc_id, n_bytes, n_tokens,
    over_limit and fit_points (code points of the longest prefix of at most ``limit`` tokens). NULL texts count as
    empty, which has no tokens; repeated rows are answered one by one; an empty table gives an empty result.
    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library, on every machine.

    For one limit only: the tables of the pieces are used where they are made. :func:`stored_token_counts` writes the table
    of all prefixes, which answers any number of limits.
    """
    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            for lo, hi in groups(n_bytes):
                n, fit = columns(tokenizer).whole(texts.slice(lo, hi - lo), limit)
                own = [batch.column("doc_id").slice(lo, hi - lo), n_bytes.slice(lo, hi - lo), *map(pa.array, (n, n > limit, fit))]
                yield pa.RecordBatch.from_arrays(own, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_points"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long,n_bytes long,n_tokens long,over_limit boolean,fit_points long")


def stored_token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """:func:`token_counts` by way of the stored prefix table: written once, the answers are look-ups in it."""
    return answers(settle(prefix_parts(docs, tokenizer), compression="zstd"), limit)


def answers(stored: DataFrame, limit: int) -> DataFrame:
    """``token_counts`` for one limit, from the stored parts; only a part that the limit lies in is searched."""
    fits = F.transform("counts", lambda n: F.col("base") + n <= limit)
    behind = F.array_position(F.reverse(fits), True)
    place = (
        F.when(F.col("highest") <= limit, F.size("counts")).when(F.col("lowest") > limit, F.lit(None))
        .when(behind > 0, F.size("counts") - behind + 1)
    )
    rows = stored.select("uid", "doc_id", "n_bytes", "part", "last", (F.col("part").cast("long") * PART + place).alias("fit"))
    n = F.max_by("last", "part").cast("long")
    out = rows.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), n.alias("n_tokens"), F.max("fit").alias("fit"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.coalesce("fit", F.lit(0)).alias("fit_points"))


def prefix_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ``counts``: the token count of every prefix, from the empty one on, by code points.

    ``element_at(counts, i + 1)`` is the count of the first i code points; budgets and cuts of any kind are then plain
    SQL. NULL texts count as empty and have the one count 0.
    """
    def run(cols):
        c = counter(tokenizer)
        return {"doc_id": cols["doc_id"], "counts": [c.prefixes(t or "") for t in cols["text"]]}

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_columns(narrow, run, "doc_id long,counts array<int>")
