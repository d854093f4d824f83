import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest

from scanloom.llm.sharding import equal_capacities, min_cost_flow, reshard_documents, rewrite, shard_documents
from scanloom.session import new_folder


def brute(supply, capacity, cost):
    """Least cost by trying every placement of unit amounts."""
    units = [i for i, s in enumerate(supply) for _ in range(s)]
    best = None
    for where in itertools.product(range(len(capacity)), repeat=len(units)):
        if all(where.count(j) <= c for j, c in enumerate(capacity)):
            total = sum(cost[i][j] for i, j in zip(units, where))
            best = total if best is None else min(best, total)
    return best


@pytest.mark.parametrize("seed", range(30))
def test_flow_is_cheapest(seed):
    rng = random.Random(seed)
    supply = [rng.randint(0, 3) for _ in range(rng.randint(1, 3))]
    capacity = [rng.randint(0, 3) for _ in range(3)]
    capacity[0] += max(0, sum(supply) - sum(capacity))
    cost = [[rng.randint(0, 4) for _ in capacity] for _ in supply]
    flow = min_cost_flow(supply, capacity, cost)
    assert [sum(f) for f in flow] == supply
    assert all(sum(f[j] for f in flow) <= c for j, c in enumerate(capacity))
    assert sum(f * c for row, costs in zip(flow, cost) for f, c in zip(row, costs)) == brute(supply, capacity, cost)


def test_flow_keeps_what_fits():
    supply = [50, 10, 0]
    flow = min_cost_flow(supply, [20] * 3, [[int(i != j) for j in range(3)] for i in range(3)])
    assert flow[0][0] == 20 and flow[1][1] == 10
    with pytest.raises(ValueError):
        min_cost_flow([2], [1], [[0]])
    assert equal_capacities(10, 4) == [3, 3, 2, 2]


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    rows = shard_documents(docs, 16, 12, blocks=8).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    slots, sizes, old = defaultdict(list), Counter(), Counter()
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        assert r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        old[r.old_shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(sizes.values()) / 16, max(r.size for r in rows)
    assert all(abs(sizes[i] - mean) <= 13 * largest for i in range(16))
    moved = sum(r.size for r in rows if r.shard != r.old_shard)
    least = sum(max(0, n - mean) for n in old.values())
    assert moved <= least + 13 * 16 * largest
    path = new_folder(spark, "shards")
    traffic = rewrite(docs, shard_documents(docs, 16, 12, blocks=8), path)
    written = spark.read.parquet(path)
    assert written.count() == sum(1 for r in rows if r.shard in {t.shard for t in traffic.collect()})


def test_edge_rows(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "é", "a", None), (2, "b" * 1000, "a", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")
    got = shard_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 3), (1, 1), (1, 1), (2, 1001)]
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(docs.limit(0)).collect() == []


def test_rewritten_shards_hold_every_row(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "é", "a", None), (2, "b" * 1000, "a", "y"), (2, "c", "b", "z"), (2, "c", "b", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")
    path, other = new_folder(spark, "shards"), new_folder(spark, "shards")
    want = Counter(rows)
    got = reshard_documents(docs, 3, 2, path=path).collect()
    assert Counter((r.doc_id, r.text, r.source, r.shard_) for r in spark.read.parquet(path).collect()) == want
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((d or 0, len((t or "").encode()) + 1) for d, t, _, _ in rows)
    # The present shards, with one that is emptied and one that stays as it is.
    places = spark.createDataFrame(
        [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), *p) for (d, t, _, _), p in zip(rows, [(0, 1, 0), (0, 1, 1), (1, 1, 2), (2, 2, 0), (1, 1, 3), (1, 1, 4)])],
        "doc_id long, size long, text_crc32 long, old_shard int, shard int, slot long",
    )
    for n in range(3):
        spark.createDataFrame([(f"old {n}",)], "text string").coalesce(1).write.parquet(f"{other}/shard={n}")
    assert sorted(map(tuple, rewrite(docs, places, other).collect())) == [(0, 0, 2), (1, 2, 0)]
    now = spark.read.schema("text string, doc_id long, source string, shard_ string, slot long, shard int").parquet(other).collect()
    assert [r.text for r in now if r.shard != 1] == ["old 2"]
    assert Counter((r.doc_id, r.text, r.source, r.shard_) for r in now if r.shard == 1) == want - Counter([rows[3]])
    assert reshard_documents(docs.limit(0)).collect() == []
