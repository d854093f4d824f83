import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from scanloom.llm.best_fit_packing import ChunkIds, Search, best_fit_packing, plan_packing

PATH = P.path("word_bpe_49k.json")


def optimum(items, capacity):
    """Fewest bins: per subset of the items the fewest, and of those the least fill of the last one."""
    best = [(99, 0)] * (1 << len(items))
    best[0] = (0, capacity + 1)
    for m in range(1 << len(items)):
        bins, fill = best[m]
        for i, x in enumerate(items):
            if not m >> i & 1:
                new = (bins, fill + x) if fill + x <= capacity else (bins + 1, x)
                best[m | 1 << i] = min(best[m | 1 << i], new)
    return best[-1][0]


def test_chunks_equal_whole_texts():
    own, lib = ChunkIds(PATH), Tokenizer.from_file(PATH)
    texts = ["", " ", "It's We'RE  x\n\ny\tz", "ÉÀ é ́a ΑΣ σΣ", "a b　c d", "<|endoftext|>x<|startoftext|> y", "a\x1cb\x85c", "日本 語🙂"]
    rng = random.Random(3)
    parts = ["The", " ", "\n", "'s", "'", "É", "́", "12", "!!", " ", "Σ", "<|endoftext|>", "<|", "ff"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    column = pa.array(["x y", *texts, "z"])[1:-1]
    for _ in range(2):
        ids, bounds = own.of(column)
        for t, a, b in zip(texts, bounds, bounds[1:]):
            assert ids[a:b].tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    ids, bounds = own.of(pa.array(["", " "]))
    assert len(ids) == 0 and bounds.tolist() == [0, 0, 0]


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 30) for _ in range(rng.randint(1, 10))]
    counts = {x: items.count(x) for x in items}
    plan = plan_packing(counts, 30)
    back = defaultdict(int)
    for lens, k in plan:
        assert sum(lens) <= 30
        for x in lens:
            back[x] += k
    assert dict(back) == counts
    assert sum(k for _, k in plan) == optimum(items, 30)


def test_optimum_whenever_the_search_ran_out():
    rng, branched = random.Random(11), 0
    for _ in range(2000):
        n = rng.randint(9, 10) if rng.random() < 0.9 else rng.randint(11, 13)
        items = [rng.randint(*rng.choice([(1, 100), (10, 60), (15, 50)])) for _ in range(n)]
        search = Search(100)
        plan = search.run(Counter(items))
        back = Counter()
        for lens, k in plan:
            assert sum(lens) <= 100
            back.update({x: c * k for x, c in Counter(lens).items()})
        assert back == Counter(items)
        if search.proven:
            assert search.best == optimum(items, 100), items
            branched += 1
    assert branched > 1900
    hard = [16, 16, 17, 21, 23, 24, 29, 31, 31, 39, 46, 49, 50]
    assert sum(k for _, k in plan_packing(Counter(hard), 100)) == 4


def test_no_better_filling_is_dominated():
    search, rng = Search(60), random.Random(4)
    for _ in range(200):
        have = np.zeros(61, np.int64)
        for _ in range(rng.randint(3, 9)):
            have[rng.randint(3, 30)] += 1
        first = int(np.flatnonzero(have)[-1])
        search.left = 10**6
        every = set(search.maximal(have, first))
        kept = {lens[1:] for lens, _ in search.options(have, first)}
        assert kept <= every and kept
        rest = have.copy()
        rest[first] -= 1
        fullest = max(sum(x) for x in every)
        assert max(sum(x) for x in kept) == fullest
        for x in every:  # what is left of the room takes no further piece
            left = rest.copy()
            for p in x:
                left[p] -= 1
            assert (left >= 0).all() and not left[: 60 - first - sum(x) + 1].any()


def test_branching_beats_best_fit():
    counts = {6: 2, 4: 2, 3: 2, 5: 2, 2: 1}
    search = Search(10)
    search.run(counts)
    assert search.best == optimum([6, 6, 4, 4, 3, 3, 5, 5, 2], 10)


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lib = Tokenizer.from_file(PATH)
    ids = {r.doc_id: [*lib.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = best_fit_packing(docs, PATH, 512).collect()
    check(rows, ids, 512)
    total = sum(map(len, ids.values()))
    assert len({r.sequence_id for r in rows}) <= total / 512 * 1.02 + 1


def check(rows, ids, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [capacity * i for i in range(len(own))] and sum(r.length for r in own) == len(ids[doc])
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_edge_rows(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "a b", 6), (2, "", None), (3, "word " * 3000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = best_fit_packing(docs, PATH, 1000).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got) == [(0, 0, 3), (1, 0, 1), (1, 0, 1), (2, 0, 1), (3, 0, 1000), (3, 1, 1000), (3, 2, 1000), (3, 3, 1)]
    assert len({r.sequence_id for r in got}) == 4
    assert best_fit_packing(docs.limit(0), PATH).collect() == []
