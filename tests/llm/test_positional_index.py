"""Phrases and near words from the positional index, against plain scans."""

import hashlib
import random
import re

from scanloom.llm import positional_index as P

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def plain(docs, items, width=10):
    windows = [(str(i), tuple(w[s : s + width])) for i, t in items if i is not None for w in [words(t)] if w for s in range(max(1, len(w) - width + 1))]
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for i, win in windows:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    ids.add(i)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def tables(spark, seed=1):
    rng = random.Random(seed)
    vocab = ["a", "of", "the", "Señor", "x9", "über", *(f"w{i}" for i in range(30))]
    def say(n):
        return rng.choice([" ", ", ", "\n"]).join(rng.choices(vocab, [20, 15, 15] + [1] * (len(vocab) - 3), k=n))

    items = [(i, say(rng.randint(1, 40))) for i in range(12)] + [(None, "a of the"), (20, None), (21, " ,"), (3, "a a a a a a a a a a a a"), (3, "a a a a a a a a a a a a")]
    items += [(22, "zebra zebra yak"), (23, "nowhere word"), (24, "the the the the the the the the the the of")]
    docs = [(i, say(rng.randint(0, 200))) for i in range(60)]
    for i in range(40):  # whole, cut and joined test texts
        t = rng.choice([t for _, t in items if t]).split()
        cut = t[rng.randint(0, 2) :]
        docs.append((100 + i, f"{say(5)} {' '.join(cut).upper() if i % 3 else ' '.join(cut)} {say(3)} {' '.join(t)}"))
    docs += [(None, "zebra Zebra YAK"), (7, None), (8, ""), (9, "zebra"), (9, "zebra zebra zebra yak yak"), docs[5], docs[5], (10, "a " * 3000), (11, "the " * 500 + "of")]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id long, text string, row int, term int, pos int").repartition(5),
        spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, item int, at int"),
    )


def test_decontamination(spark):
    docs, items = tables(spark)
    d, b = frames(spark, docs, items)
    got = sorted((tuple(r) for r in P.decontamination(d, b).collect()), key=repr)
    assert got == plain(docs, items) and any(r[5] for r in got) and not all(r[5] for r in got)


def test_shuffled_filter_and_empty_tables(spark, monkeypatch):
    docs, items = tables(spark, 2)
    d, b = frames(spark, docs[:70], items)
    monkeypatch.setattr(P, "SENT", 3)
    assert sorted((tuple(r) for r in P.decontamination(d, b, width=6).collect()), key=repr) == plain(docs[:70], items, 6)
    assert P.decontamination(d.limit(0), b).collect() == []
    assert {r.n_hit for r in P.decontamination(d, b.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = [(0, "p red q green r blue s"), (1, "blue green red"), (2, "red " * 4 + "x x x x x x x green blue"), (3, "red green"), (4, "green x red blue x x red")]
    index = P.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    queries = P.read_queries(index, spark.createDataFrame([(1, "red green blue")], "item_id long, text string"))
    texts = {r.row: words(docs[r.doc_id][1]) for r in index.where("term IS NULL").collect()}
    chosen = [(r["at"], r["rank"]) for r in P.rarest(queries, lists=3).collect()]
    head = next(a for a, k in chosen if k == 1)
    target = ["red", "green", "blue"]
    for slop in (0, 1, 2, 4, 9):
        want = set()
        for row, w in texts.items():
            for p, x in enumerate(w):
                if x == target[head] and all(
                    any(w[q] == target[a] and abs((q - a) - (p - head)) <= slop for q in range(len(w))) for a in range(3) if a != head
                ):
                    want.add((head, row, p))
        got = {(r["at"], r["row"], r["pos"]) for r in P.proximity_matches(index, queries, slop).collect()}
        assert got == want, slop


def test_plans_use_no_python(spark):
    docs, items = tables(spark)
    d, b = frames(spark, docs, items)
    index = P.build_index(d)
    queries = P.read_queries(index, b)
    for df in (P.phrase_matches(index, queries), P.proximity_matches(index, queries, 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
