"""Exact top-k search and preference formatting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm.chat_formatting import preference_pairs, swapped_answers
from scanloom.llm.topk_search import Block, best_of, best_of_all, topk_search


def block_of(m, ids):
    postings = np.ascontiguousarray(np.argsort(-m, axis=0, kind="stable").T.astype(np.int32))
    return Block(len(m), m.shape[1], ids.tobytes(), np.ascontiguousarray(m).tobytes(), postings.tobytes())


@pytest.mark.parametrize("seed", range(12))
def test_search_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, dims = int(rng.integers(1, 1500)), int(rng.integers(1, 40))
    m = rng.integers(-300, 300, (n, dims))
    if seed % 3 == 0:
        m[rng.random(n) < 0.5] = m[0]
    if seed % 4 == 0:
        m = m // 100
    m = m.astype(np.int64)
    ids = rng.permutation(n).astype(np.int64) * 3
    cuts = np.unique([0, *rng.integers(0, n, 4).tolist(), n])
    blocks = [block_of(m[a:b], ids[a:b]) for a, b in zip(cuts, cuts[1:])]
    for q in (m[0], -m[-1], np.zeros(dims, int), rng.integers(-5, 5, dims), np.append(m[0], 7)):
        scores = m @ q[:dims]
        keep = ids != ids[0]
        want = sorted(((-s, i) for s, i in zip(scores[keep].tolist(), ids[keep].tolist())))[:10]
        got, _ = best_of(blocks, int(ids[0]), q.astype(np.int64), 10)
        assert [(-s, i) for s, i in got] == want


def test_clustered_vectors_are_not_read_in_full():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (20, 32))
    m = np.floor(np.repeat(centres, 500, 0) + rng.normal(0, 20, (10_000, 32))).astype(np.int64)
    ids = np.arange(10_000)
    blocks = [block_of(m[a : a + 500], ids[a : a + 500]) for a in range(0, 10_000, 500)]
    share = []
    for own in range(0, 10_000, 997):
        scores = m @ m[own]
        order = [i for i in np.lexsort((ids, -scores)) if i != own][:10]
        got, read = best_of(blocks, own, m[own], 10)
        assert [i for _, i in got] == order
        share.append(read / m.size)
    assert max(share) < 0.2, share
    # Within one block too, reading stops on proof where the scores fall off.
    spread = np.floor(rng.normal(0, 10, (2000, 32))).astype(np.int64)
    spread[:40] += 400
    one = block_of(spread, np.arange(2000))
    assert one.search(-1, spread[0], 10, None)[2] < 0.5 * spread.size


def test_edge_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (6, [-1.0]), (100, [0.5, -0.25]), (7, [])]
    v = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_search(v, v.where("vec_id % 100 = 0"), block_rows=3).collect()}
    assert [got[0, i] for i in range(1, 6)] == [(1, 5 << 20), (1, 5 << 20), (7, 0), (100, 0), (6, -1 << 20)]
    assert (0, 6) not in got and len([k for k in got if k[0] == 100]) == 6
    assert topk_search(v.limit(0), v.limit(0)).collect() == []
    assert topk_search(v, v.where("vec_id = 2")).collect() == []
    twice = v.where("vec_id = 1").unionByName(spark.createDataFrame([(1, [0.5], 1)], v.schema))
    asked = {(r.rank, r.vec_id, r.score) for r in topk_search(v, twice).collect()}
    assert (1, 0, 512 << 10) in asked and len(asked) == 5


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, prompt string")


def test_pairs(spark):
    a = turns(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "so"), (2, 0, "user", "q"), (3, 0, None, None),
                      (3, 0, None, None), (4, 0, "user", "only a"), (None, 0, "user", "n")])
    b = turns(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "né"), (2, 0, "user", "q"), (2, 1, "assistant", ""), (3, None, None, None), (5, 0, "user", "b")])
    got = {r.conv_id: r for r in preference_pairs(a, b).collect()}
    assert set(got) == {1, 2, 3}
    head = "<|user|>\n"
    assert got[1].n_prefix == 1 and got[1].prompt == head + "hi\n"
    assert got[1].chosen == "<|assistant|>\nyes\n" + head + "so\n" and got[1].rejected == "<|assistant|>\nné\n"
    assert got[1].chosen_mask == "14:4" and got[1].rejected_mask == "14:3"
    assert got[1].chosen[14:18] == "yes\n"
    assert got[2].chosen == "" and got[2].chosen_mask == "" and got[2].rejected_mask == "14:1"
    assert got[3].n_prefix == 1 and got[3].rejected == "" and got[3].chosen == "<||>\n\n"
    assert preference_pairs(a.limit(0), b).collect() == []


def test_swap(spark):
    a = turns(spark, [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "assistant", "c"), (1, 1, "assistant", "d"), (2, 0, "assistant", "e"), (3, 0, "user", "f")])
    got = {(r.conv_id, r.turn): r.text for r in swapped_answers(a).collect()}
    extra = a.withColumn("last", F.lit(1)).withColumn("other", F.lit("o"))
    assert {(r.conv_id, r.turn): r.text for r in swapped_answers(extra).collect()} == got
    assert got == {(0, 0): "a", (0, 1): "d", (1, 0): "c", (1, 1): "b", (2, 0): "", (3, 0): "f"}


def test_queries_search_blocks_together(monkeypatch):
    """Queries that are due in the same block are searched at once, in either kind of numbers, with the rows of brute force."""
    rng = np.random.default_rng(5)
    for scale in (1, 1 << 16):
        m = rng.integers(-900, 900, (4000, 24)).astype(np.int64) * scale
        m[1500:1900] = m[7]
        ids = np.arange(4000) // 2
        blocks = [block_of(m[a : a + 1000], ids[a : a + 1000]) for a in range(0, 4000, 1000)]
        calls = []
        monkeypatch.setattr(Block, "search_all", lambda self, own, *a, f=Block.search_all: (calls.append(len(own)), f(self, own, *a))[1])
        asked = np.arange(0, 4000, 40)
        which, scores, found, read = best_of_all(blocks, ids[asked], m[asked], 10)
        monkeypatch.undo()
        assert len(calls) <= len(blocks) ** 2 and sum(calls) > len(asked) and (read <= m.size).all()
        for j, i in enumerate(asked):
            s = m @ m[i]
            want = [x for x in np.lexsort((ids, -s)) if ids[x] != ids[i]][:10]
            assert scores[which == j].tolist() == s[want].tolist() and found[which == j].tolist() == ids[want].tolist()
