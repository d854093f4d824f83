"""Helpers that several operators share: word splitting, word hashes, text statistics, columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits at exactly these.
SPACES = " \t\n\v\f\r"
#: Distinct words a Python worker remembers before it starts afresh.
MEMO = 1 << 19


class WordHashes(dict):
    """64-bit hash per word (bytes), remembered for up to ``MEMO`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES = WordHashes()


def multipliers(n: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return np.array([xxhash.xxh3_64_intdigest(str(i), seed=7) | 1 for i in range(n)], np.uint64)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; empty when there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    out = np.zeros(size, np.uint64)
    for k, m in enumerate(multipliers(n)):
        out += hashes[k : k + size] * m
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; NULL ids count as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def map_columns(df: DataFrame, fn, schema: str) -> DataFrame:
    """Apply ``fn(columns: dict[str, list]) -> dict[str, list or array]`` to every Arrow batch of ``df``."""
    names = [x.split()[0].strip("`") for x in schema.split(",")]
    wanted = {n: None for n in names}

    def run(batches):
        target = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = fn({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)})
            if target is None:
                target = pa.schema([(n, ARROW[t]) for n, t in (x.split() for x in schema.split(","))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(got[n], target.field(n).type) for n in wanted], schema=target
            )

    return df.mapInArrow(run, schema)


ARROW = {
    "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
    "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
    "array<float>": pa.list_(pa.float32()), "array<string>": pa.list_(pa.string()),
}

#: Counts of a text that the quality operators share, in the order ``statistics`` returns them.
STATISTICS = (
    "n_bytes", "n_points", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_distinct", "n_runs", "n_upper", "n_lower", "n_digits", "n_shouts", "n_bars", "n_stops", "n_marks",
    "n_wide", "n_capitals", "n_top", "n_ended",
)
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
SHARP = frozenset(b"!?.,;:")


def repeated_words(hashes: np.ndarray, width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more, their first occurrence included."""
    found = windows(hashes, width)
    if len(found) < 2:
        return 0
    order = np.argsort(found, kind="stable")
    same = found[order[1:]] == found[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(found), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edges = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    edges[at] += 1
    edges[at + width] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """``STATISTICS`` of one whole text; all zero when it is NULL or empty.

    Case is not folded. ``n_lines`` counts lines with a word, ``n_runs`` words equal to the word before,
    ``n_top`` the most frequent word, ``n_ended`` lines with a word that end in a sentence mark.
    """
    if not text:
        return (0,) * len(STATISTICS)
    raw = text.encode()
    words = raw.split()
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    n_upper, n_lower = without(UPPER), without(LOWER)
    wide = 0
    if len(raw) != len(text):
        others = [c for c in set(text) if c > "\x7f"]
        for c in others:
            n = text.count(c)
            wide += n
            n_upper += n * c.isupper()
            n_lower += n * c.islower()
    distinct = set(words)
    runs = top = capitals = repeat = 0
    if words:
        hashes = HASHES.of(words)
        runs = int((hashes[1:] == hashes[:-1]).sum())
        ordered = np.sort(hashes)
        edges = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        top = int(np.diff(np.append(edges, len(ordered))).max())
        capitals = sum(map(bytes.istitle, distinct))
        repeat = repeated_words(hashes)
    return (
        len(raw), len(text), len(words), len(text) - sum(map(text.count, SPACES)), without(b"#*$%&|<>"),
        len(lines), len(lines) - len(set(lines)), repeat, len(distinct), runs, n_upper, n_lower,
        without(b"0123456789"), raw.count(b"!"), raw.count(b"|"), raw.count(b"."), without(b"!?.,;:\"'()-"),
        wide, capitals, top, sum(x.rstrip(SPACES)[-1:] in ".!?" for x in lines),
    )


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the ``STATISTICS`` of every whole text, one pass over the texts."""
    def run(cols):
        rows = np.array([statistics(t) for t in cols["text"]], np.int64).reshape(-1, len(STATISTICS))
        return {"doc_id": cols["doc_id"], **{n: rows[:, i] for i, n in enumerate(STATISTICS)}}

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_columns(narrow, run, "doc_id long," + ",".join(f"{n} long" for n in STATISTICS))
