"""Quality rules and the quality classifier."""

import random
import re
import zlib

import numpy as np
import pytest

from scanloom.llm import quality_classifier as C
from scanloom.llm import quality_rules as R
from scanloom.llm.common import STATISTICS, statistics

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = set("#*$%&|<>")


def brute(text):
    """The base counts, straight from their definition."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in SYMBOLS for c in text), dup, len(inside)


def base(text):
    s = dict(zip(STATISTICS, statistics(text)))
    return s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]


def test_base_counts():
    rng = random.Random(2)
    parts = ["a", "b", "été", " ", " ", "\n", "\n\n", "\t", "$", "|", "x y z w v u t s ", "\x0b", "\x85", "　"]
    texts = [None, "", " \n ", "a " * 9, "a a"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for t in texts:
        assert base(t) == brute(t), repr(t)


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = R.quality_rules(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, *rest = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * rest[3] > 30 * n)
        assert not (r.base_failed and r.kept) and r.kept == (not r.base_failed and r.posterior >= 0.5)


def plain_em(votes, rounds):
    """The same estimation document by document."""
    n, k = votes.shape
    prior, reject = 0.8, np.tile([0.3, 0.01], (k, 1))
    weight = 50.0 * np.array([0.2, 0.8])  # of documents, however many there are
    start = reject.copy()
    for _ in range(rounds):
        p = np.empty(n)
        for i in range(n):
            like = [1 - prior, prior]
            for j in range(k):
                for c in (0, 1):
                    like[c] *= {-1: reject[j, c], 1: 1 - reject[j, c], 0: 1}[votes[i, j]]
            p[i] = like[1] / sum(like)
        for j in range(k):
            for c, w in ((0, 1 - p), (1, p)):
                reject[j, c] = (w[votes[:, j] < 0].sum() + start[j, c] * weight[c]) / (w[votes[:, j] != 0].sum() + weight[c])
        prior = (p.sum() + 4) / (n + 5)
    return prior, reject


def test_estimation_equals_plain_one():
    rng = np.random.default_rng(1)
    good = rng.random(600) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.7])
    votes = np.where(rng.random((600, 4)) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[rng.random((600, 4)) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    got = R.estimate(patterns, counts.astype(float), list("abcd"), rounds=20)
    prior, reject = plain_em(votes, got.rounds)
    assert got.prior == pytest.approx(prior) and np.allclose(got.reject, reject)
    accuracy = list(got.accuracy().values())
    assert accuracy[0] > accuracy[3]
    assert ((got.posterior(votes) >= 0.5) == good).mean() > 0.85


def test_estimates_approach_the_truth_as_documents_grow():
    bad, good = np.array([0.9, 0.8, 0.7, 0.85]), np.array([0.05, 0.1, 0.05, 0.2])
    worst = []
    for n in (500, 5_000, 500_000):
        rng = np.random.default_rng(7)
        fine = rng.random(n) < 0.75
        votes = np.where(rng.random((n, 4)) < np.where(fine[:, None], good, bad), -1, 1)
        votes[rng.random((n, 4)) < [0.1, 0.2, 0.1, 0.97]] = 0  # the last rule votes rarely
        patterns, counts = np.unique(votes, axis=0, return_counts=True)
        got = R.estimate(patterns, counts.astype(float), list("abcd"), rounds=1000)
        worst.append(max(np.abs(got.reject[:, 0] - bad).max(), np.abs(got.reject[:, 1] - good).max(), abs(got.prior - 0.75)))
    assert worst[2] < 0.02 and worst[2] < worst[1] < worst[0], worst


def test_rules_follow_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = R.quality_rules(docs).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.15


def test_edge_rows(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "a b", 6), (2, "", None), (3, "word other more " * 5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, votes int")
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in R.quality_rules(docs).collect())
    assert got == [(0, 2, True, False), (1, 0, True, False), (1, 0, True, False), (2, 0, True, False), (3, 15000, True, False)]
    assert R.quality_rules(docs.limit(0)).collect() == []
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None), (3, 0), (3, 0)], "doc_id long, quality int")
    got = C.quality_classifier(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 for r in C.quality_classifier(docs, labels.limit(0)).collect())
    assert C.quality_classifier(docs.limit(0), labels).collect() == []


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = C.quality_classifier(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert np.mean([r.predicted == known[r.doc_id] for r in held]) > 0.95


def test_flat_traversal_equals_walk():
    rng = np.random.default_rng(0)
    x = rng.random((500, C.N_FEATURES))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    forest = C.train(x, y, trees=10, depth=3)

    def walk(row):
        total = forest.start
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] + (row[forest.feature[node]] > forest.threshold[node])
            total += forest.value[node]
        return total

    assert np.allclose(forest.margin(x), [walk(r) for r in x])
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.9
