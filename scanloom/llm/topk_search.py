"""Exact top-k inner products over an impact-ordered index, score at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.session import settle
from scanloom.sources.files import Opened

INDEX = "cell int, n int, dims int, ids binary, matrix binary, postings binary"
#: Most pivots that rows are gathered around, blocks of a shard, and steps in which a block's impacts are taken.
PIVOTS, SHARD_BLOCKS, STEPS = 64, 16, 12
#: So few rows of a block left are rescored at once; queries that search a block together; pairs rescored at a time.
ENOUGH, TOGETHER, RESCORED = 512, 128, 1 << 14
#: Less than any score, with room for sums.
NO_BAR = -(1 << 62)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite numbers."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)))


def whole_numbers(vectors: Sequence, dims: int) -> np.ndarray:
    """floor(1024 * x) of every component; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : min(dims, len(v))] = np.asarray(v, np.float64)[:dims]
    return np.floor(1024.0 * out).astype(np.int64)


def nearest_pivot(vectors: Sequence, pivots: np.ndarray) -> np.ndarray:
    """The pivot of the largest cosine for each vector; only the gathering of like rows depends on it."""
    dims = max(pivots.shape[1], max(map(len, vectors), default=0))
    v, p = np.zeros((len(vectors), dims)), np.zeros((len(pivots), dims))
    p[:, : pivots.shape[1]] = pivots
    for i, x in enumerate(vectors):
        v[i, : len(x)] = x
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-30)
    return np.argmax(v @ p.T, axis=1)


def build_index(rows: DataFrame, block_rows: int = 2048) -> DataFrame:
    """Blocks of like rows, written to the shared folder: ids, values, and each dimension's rows from the largest value down.

    Rows are gathered around some of them, one for each block's worth and ``PIVOTS`` at most. A pivot's rows are dealt into as many shards as they need, by row, so one
    vector that a third of the rows have fills many shards; a task cuts a shard into blocks by length of the vectors.
    """
    wanted = min(PIVOTS, max(1, rows.count() // block_rows))
    some = rows.orderBy(F.xxhash64("vec_id", "embedding")).limit(wanted).collect()
    pivots = np.zeros((max(1, len(some)), max((len(r["embedding"]) for r in some), default=1)))
    for i, r in enumerate(some):
        pivots[i, : len(r["embedding"])] = r["embedding"]

    def gather(batches):
        for pdf in batches:
            yield pdf.assign(cell=nearest_pivot(list(pdf["embedding"]), pivots).astype("int32"))

    kind = rows.schema["embedding"].dataType.simpleString()
    placed = settle(rows.mapInPandas(gather, f"vec_id long, embedding {kind}, cell int").withColumn("row", F.monotonically_increasing_id()))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (block_rows * SHARD_BLOCKS)).cast("int").alias("shards"))
    dealt = placed.join(F.broadcast(sizes), "cell")  # one row for each pivot
    shard = F.pmod(F.xxhash64("row"), F.col("shards")).cast("int")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = list(pdf["embedding"])
        dims = max(map(len, vectors))
        m = whole_numbers(vectors, dims)
        order = np.argsort(-(m.astype(np.float64) ** 2).sum(1), kind="stable")
        m, ids, out = m[order], pdf["vec_id"].to_numpy(np.int64)[order], []
        for at in range(0, len(m), block_rows):
            part = np.ascontiguousarray(m[at : at + block_rows])
            postings = np.ascontiguousarray(np.argsort(-part, axis=0, kind="stable").T.astype(np.int32))
            out.append((pdf["cell"].iloc[0], len(part), dims, ids[at : at + block_rows].tobytes(), part.tobytes(), postings.tobytes()))
        return pd.DataFrame(out, columns=["cell", "n", "dims", "ids", "matrix", "postings"])

    return settle(dealt.withColumn("shard", shard).groupBy("cell", "shard").applyInPandas(build, INDEX))


class Block:
    """An index row, opened: its lists merged into one by impact.

    A posting's impact is the distance of its value from the middle of its dimension in the block, so impacts are not
    negative and the merged list serves queries of any signs.
    """

    def __init__(self, n: int, dims: int, ids: bytes, matrix: bytes, postings: bytes):
        self.n, self.dims = n, dims
        self.ids = np.frombuffer(ids, np.int64)
        self.matrix = np.frombuffer(matrix, np.int64).reshape(n, dims)
        lists = np.frombuffer(postings, np.int32).reshape(dims, n)
        levels = np.take_along_axis(self.matrix.T, lists, 1)
        self.top, self.low = levels[:, 0], levels[:, -1]
        self.middle = np.floor(levels.mean(1)).astype(np.int64)
        gains = (levels - self.middle[:, None]).ravel()
        order = np.argsort(-np.abs(gains), kind="stable")
        self.gains = gains[order]
        self.places = lists.ravel()[order].astype(np.int64) * dims + order // max(n, 1)
        self.largest = int(np.abs(self.matrix).max(initial=0))

    def sized(self, queries: np.ndarray) -> np.ndarray:
        q = np.zeros((len(queries), self.dims), np.int64)
        both = min(self.dims, queries.shape[1])
        q[:, :both] = queries[:, :both]
        return q

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No row of the block scores more, for each query."""
        q = self.sized(queries)
        return np.maximum(q, 0) @ self.top + np.minimum(q, 0) @ self.low

    def search(self, own: int, query: np.ndarray, k: int, bar: int | None, enough: int = ENOUGH) -> tuple[np.ndarray, np.ndarray, int]:
        """:meth:`search_all` for one query."""
        bars = np.array([NO_BAR if bar is None else bar], np.int64)
        _, scores, ids, read = self.search_all(np.array([own]), query[None], k, bars, enough)
        return scores, ids, int(read[0])

    def search_all(self, own: np.ndarray, queries: np.ndarray, k: int, bars: np.ndarray, enough: int = ENOUGH):
        """(query's place, score, id) of all rows that may be among a query's best ``k``, and how many postings each read.

        ``bars`` are scores that ``k`` other rows reach, ``NO_BAR`` if unknown. Impacts are quantised: a step's threshold
        is half of the one before. A step reads the next segment of the merged list, largest impacts first, and adds
        the postings' exact gains to the rows' scores, for all queries at once. What a row's unread postings add or take
        away is bounded by the largest impact left, in the dimensions in which it has not been read. Rows whose upper bound
        is under the bar, or under ``k`` lower bounds, are out; a query stops when few rows are left, which are rescored in full.
        """
        q = self.sized(queries)
        # Products of whole numbers are exact in floating point up to 2 ** 53.
        weight = int(np.abs(q).sum(1).max(initial=0))
        kind = np.float64 if 4 * weight * max(self.largest, 1) < 1 << 53 else np.int64
        part, unread = np.zeros(self.matrix.shape, kind), np.ones(self.matrix.shape, kind)
        size = np.abs(q)
        possible = self.ids != own[:, None]
        bars, read, at = bars.copy(), np.zeros(len(q), np.int64), 0
        live = np.arange(len(q))
        for step in range(1, STEPS + 1):
            live = live[possible[live].sum(1) > max(k, enough)]
            if not len(live) or at == len(self.gains):
                break
            impact = abs(int(self.gains[0])) >> step
            to = len(self.gains) if step == STEPS else int(np.searchsorted(-np.abs(self.gains), -impact, side="left"))
            part.ravel()[self.places[at:to]] = self.gains[at:to]
            unread.ravel()[self.places[at:to]] = 0
            at = to
            left = abs(int(self.gains[to])) if to < len(self.gains) else 0
            read[live] = to
            mine = q[live].astype(kind)
            sums = mine @ part.T + (mine @ self.middle.astype(kind))[:, None]
            slack = size[live].astype(kind) @ unread.T * left
            if self.n >= k:
                sure = np.where(self.ids != own[live][:, None], sums - slack, NO_BAR)
                bars[live] = np.maximum(bars[live], np.partition(sure, self.n - k, 1)[:, self.n - k].astype(np.int64))
            possible[live] &= sums + slack >= bars[live][:, None]
        which, rows = np.nonzero(possible)
        scores = np.concatenate([np.zeros(0, np.int64), *(
            np.einsum("ij,ij->i", self.matrix[rows[i : i + RESCORED]], q[which[i : i + RESCORED]]) for i in range(0, len(rows), RESCORED)
        )])
        return which, scores, self.ids[rows], read


def best_of(blocks: Sequence[Block], own: int, query: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
    """:func:`best_of_all` for one query: its best (score, id), and the postings read."""
    which, scores, ids, read = best_of_all(blocks, np.array([own]), query[None], k)
    return list(zip(scores.tolist(), ids.tolist())), int(read[0])


def best_of_all(blocks: Sequence[Block], own: np.ndarray, queries: np.ndarray, k: int):
    """(query's place, score, id) of the ``k`` best of all blocks for each query, in order, ties to smaller ids, without rows
    of the query's id; and the postings that each read.

    A query goes through the blocks from the largest bound down, and leaves once a block's bound is under its ``k``-th
    score. In each round, queries that are due in the same block search it together, ``TOGETHER`` at a time.
    """
    m = len(queries)
    bounds = np.stack([b.bounds(queries) for b in blocks], 1)
    turns = np.argsort(-bounds, axis=1, kind="stable")
    which, scores, ids = (np.zeros(0, np.int64) for _ in range(3))
    bars, read = np.full(m, NO_BAR, np.int64), np.zeros(m, np.int64)
    live = np.arange(m)
    for turn in range(len(blocks)):
        live = live[bounds[live, turns[live, turn]] >= bars[live]]
        due = turns[live, turn]
        found = [(which, scores, ids)]
        for i in np.unique(due):
            mine = live[due == i]
            for at in range(0, len(mine), TOGETHER):
                some = mine[at : at + TOGETHER]
                w, s, v, n = blocks[i].search_all(own[some], queries[some], k, bars[some])
                read[some] += n
                found.append((some[w], s, v))
        which, scores, ids = map(np.concatenate, zip(*found))
        order = np.lexsort((ids, -scores, which))
        which, scores, ids = which[order], scores[order], ids[order]
        nth = np.arange(len(which)) - np.searchsorted(which, which)
        which, scores, ids, nth = (x[nth < k] for x in (which, scores, ids, nth))
        bars[which[nth == k - 1]] = scores[nth == k - 1]
    return which, scores, ids, read


def batches_of(paths: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Queries from the settled files, a few thousand at a time."""
    systems = Opened()
    for path in paths:
        system, inner = systems.of(path)
        with system.open_input_file(inner) as f:
            for batch in pq.ParquetFile(f).iter_batches(4096, columns=["vec_id", "embedding"]):
                yield batch.to_pandas()


def topk_search(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 2048) -> DataFrame:
    """Each query's ``k`` rows of largest integer inner product: query_id, rank, vec_id, score.

    Both inputs have vec_id and embedding; other columns are ignored. A component x counts as floor(1024 * x), x below
    2 ** 17 in size. NULL vectors, vectors with NULL or non-finite components and rows without an id take no part; a
    shorter vector is taken to end in zeros. A query's own row is any row of its id. Repeated rows are rows of their
    own as candidates, an id repeated among the queries asks once, with its least vector. Ties go to smaller ids; fewer
    candidates give fewer rows; an empty table gives an empty result.

    The index is not moved: a task opens the blocks of its part of it and reads the settled queries file by file, a batch
    at a time; only ``k`` rows for each query and task go through a shuffle.
    """
    index = build_index(usable(vectors), block_rows)
    asked = settle(usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    paths = asked.inputFiles()  # as many as the tasks that wrote them
    target = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        blocks = [Block(*row) for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("n", "dims", "ids", "matrix", "postings")))]
        if not blocks:
            return
        for pdf in batches_of(paths):
            own, longest = pdf["vec_id"].to_numpy(np.int64), max(map(len, pdf["embedding"]), default=0)
            which, scores, ids, _ = best_of_all(blocks, own, whole_numbers(list(pdf["embedding"]), longest), k)
            if len(which):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (own[which], ids, scores)], schema=target)

    found = index.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
