import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import lm_scoring as L

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [L.END]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def base(rows):
    """(n_tokens, n_known, N, base_score) of every row, from the definition."""
    c = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [(len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x))) for _, x in rows]


def test_base_and_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = dict(zip((d for d, _ in rows), base(rows)))
    got = {r.doc_id: r for r in L.lm_scoring(docs, head=5_000).collect()}
    assert set(got) == set(want)
    for d, (n, known, total, score) in want.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held(d))
        assert r.base_score == pytest.approx(score, rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_score_equals_brute_force(spark, monkeypatch):
    """The score of the trained weights, token by token, and that probabilities of all tokens sum to one."""
    texts = ["the cat sat on the mat", "The dog sat on a log", "a cat and a dog", "été où ça", "the the the", "new words here"] * 4
    rows = list(enumerate(texts)) + [(100, None)]
    kept = {}
    monkeypatch.setattr(L, "scored", lambda docs, tables, weights, f=L.scored: (kept.update(t=tables.value, w=weights), f(docs, tables, weights))[1])
    got = {r.doc_id: r for r in L.lm_scoring(spark.createDataFrame(rows, "doc_id long, text string"), head=3).collect()}
    t, w = kept["t"], kept["w"]
    c = Counter(x for d, s in rows if not held(d) for x in tokens(s))
    singles = [x for x, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: L.SINGLES]]
    k = lambda x: singles.index(x) if x in singles else L.suffix_class(x.encode())
    n, v = Counter(), Counter()
    for x, m in c.items():
        n[k(x)] += m
        v[k(x)] += 1
    assert [n[i] for i in range(L.CLASSES)] == t.class_tokens.tolist()
    within = lambda x: (c[x] + 0.1) / (n[k(x)] + 0.1 * (v[k(x)] + 1))
    for i in {k(x) for x in c}:
        total = sum(within(x) for x in c if k(x) == i) + 0.1 / (n[i] + 0.1 * (v[i] + 1))
        assert total == pytest.approx(1)
    for d, s in rows:
        words = tokens(s)
        f = L.features(L.HASHES.of([x.encode() for x in words[:-1]]))
        log = L.log_classes(w.astype(np.float64), f)
        assert np.allclose(np.exp(log).sum(1), 1)
        want = sum(log[i, k(x)] / math.log(10) + math.log10(within(x)) for i, x in enumerate(words))
        assert got[d].score == pytest.approx(want, abs=1e-4)


def test_features_look_back_only():
    h = np.arange(1, 6, dtype=np.uint64)
    f = L.features(h)
    assert f.shape == (6, 3)
    g = L.features(np.append(h[:3], np.uint64(99)))
    assert (f[:4] == g[:4]).all() and (f[4] != g[4]).any()
    assert L.features(h[:0]).shape == (1, 3)


def test_descent_lowers_loss():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 50, (4000, 3))
    y = (f[:, 0] * 7 % L.CLASSES).astype(np.int64)
    w, squares, seen = np.zeros((L.ROWS + 1, L.CLASSES), np.float32), np.zeros(L.ROWS + 1, np.float32), np.zeros(L.ROWS + 1)
    loss = lambda: -L.log_classes(w, f)[np.arange(len(y)), y].mean()
    before = loss()
    for i in range(90):
        L.descend(w, squares, f, y, 0.5, seen, i)
    assert loss() < before / 2 and seen[-1] == 90 * 4000


def test_every_step_teaches_all_groups(spark):
    """A task of one step, and of any number, moves the rows of all three feature groups."""
    assert L.CLASSES == 48
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string").coalesce(1)
    words = sorted({*L.words_of(text), L.END.encode()})
    k = np.array([L.suffix_class(x) for x in words])
    tables = L.Tables(words, np.full(len(words), 3), k, 3 * 41, 41, np.bincount(k, minlength=L.CLASSES) * 3, np.bincount(k, minlength=L.CLASSES))
    w = L.trained(docs, spark.sparkContext.broadcast(tables), np.zeros((L.ROWS + 1, L.CLASSES), np.float32))
    f = L.features(L.HASHES.of(L.words_of(text)))
    assert all(w[f[:, j]].any(1).all() for j in range(3))


def test_class_column(spark):
    words = ["a", "ab", "abc", "été", "日本語", "\n", "the", ""]
    df = spark.createDataFrame([(x,) for x in words], "word string").select("word", L.class_column(F.col("word"), ["the"]).alias("k"))
    assert {r.word: r.k for r in df.collect()} == {x: 0 if x == "the" else L.suffix_class(x.encode()) for x in words}


def test_edge_rows(spark):
    rows = [(1, None, 1.0), (1, None, 1.0), (None, "A b", 2.0), (2, "", None), (3, "w " * 20000, 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens) for r in L.lm_scoring(docs).collect())
    want = base([(d, x) for d, x, _ in rows])
    assert got == sorted((d or 0, *b[:3]) for (d, _, _), b in zip(rows, want))
    assert L.lm_scoring(docs.where("doc_id is null")).first().n_known == 0
    assert L.lm_scoring(docs.limit(0)).collect() == []


def test_features_act_inside_classes(spark, monkeypatch):
    """With ``inner`` a class' tokens depend on the words before: scores by brute force, probabilities that sum to one."""
    texts = ["blue car red bar", "red bar blue car", "a blue car", "the red bar", "été où ça"] * 8
    rows = [(i, f"{x} u{i}") for i, x in enumerate(texts)] + [(200, None)]
    monkeypatch.setattr(L, "top_singles", lambda vocabulary: ["blue", "red"])  # car and bar share a class, told apart only inside it
    kept = {}
    monkeypatch.setattr(L, "scored", lambda docs, tables, weights, f=L.scored: (kept.update(t=tables.value, w=weights), f(docs, tables, weights))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in L.lm_scoring(docs, head=20, inner=True).collect()}
    t, w = kept["t"], kept["w"].astype(np.float64)
    c = Counter(x for d, s in rows if not held(d) for x in tokens(s))
    k = lambda x: ["blue", "red"].index(x) if x in ("blue", "red") else L.suffix_class(x.encode())
    assert k("car") == k("bar")
    head = {x.decode(): int(m) for x, m in zip(t.words, t.members)}
    assert len(head) < len(c)
    m = lambda x: head[x] if x in head else L.shared_member(x.encode())
    n, v = Counter(), Counter()
    for x, times in c.items():
        n[k(x), m(x)] += times
        v[k(x), m(x)] += 1
    within = lambda x: (c[x] + 0.1) / (n[k(x), m(x)] + 0.1 * (v[k(x), m(x)] + 1))
    inside = {}
    for d, s in rows:
        words = tokens(s)
        f = L.features(L.HASHES.of([x.encode() for x in words[:-1]]))
        ks = np.array([k(x) for x in words])
        outer, inner = L.log_classes(w[: L.ROWS + 1], f), L.log_classes(w[L.ROWS + 1 :], L.inner_features(f, ks))
        assert np.allclose(np.exp(outer).sum(1), 1) and np.allclose(np.exp(inner).sum(1), 1)
        want = 0.0
        for i, x in enumerate(words):
            want += outer[i, k(x)] / math.log(10) + math.log10(within(x))
            if k(x) >= L.SINGLES:
                want += inner[i, m(x)] / math.log(10)
                if i:
                    inside[words[i - 1], x] = inner[i, [m("car"), m("bar")]]
        assert got[d].score == pytest.approx(want, abs=1e-4)
    # The word before chooses among the tokens of one class.
    after_blue, after_red = inside["blue", "car"], inside["red", "bar"]
    assert after_blue[0] - after_blue[1] > after_red[0] - after_red[1] + 0.1
