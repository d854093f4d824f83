import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import mixing as M


def labelled(spark):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", M.domain_of_labels().alias("domain"))
    return spark.read.parquet(f"{d}/documents.parquet"), labels.where(F.col("domain").isNotNull())


def test_rates_meet_targets(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 500), *np.random.default_rng(i).dirichlet([1, 0.3, 0.2]).tolist()) for i in range(500)]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    a = np.array([[r[1] * p for p in r[2:]] for r in rows])
    for weights in ([0.3, 0.3, 0.4], [0.98, 0.01, 0.01]):
        target = [w * a.sum() for w in weights]
        r = np.zeros(500)
        got = M.rates(members, target, tolerance=1e-3).collect()
        for x in got:
            r[x.doc_id] = x.rate
        assert (r >= 0).all() and len(got) == 500
        assert np.allclose(a.T @ r, target, rtol=2e-3)
        # The same descent, document by document.
        b = a / np.array(target)
        own, before, length = np.ones(500), math.inf, 1.0
        for _ in range(60):
            free = b[own > 0]
            pull, worst = M.descent(list(b.T @ own), list((free.T @ free)[np.triu_indices(3)]), [1.0, 1.0, 1.0])
            if worst <= 1e-3 or abs(before - worst) < 1e-5:
                break
            length = length / 2 if worst > before else length
            before = worst
            own = np.maximum(0, own - b @ (length * pull))
        assert np.allclose(own, r, atol=1e-6)


def test_memberships_follow_labels(spark):
    docs, labels = labelled(spark)
    rows = M.mix(docs, labels, {"good": 0.9, "low": 0.05, "toxic": 0.05}).collect()
    assert len(rows) == docs.count()
    assert all(r.p_good + r.p_low + r.p_toxic == pytest.approx(1) and r.rate >= 0 for r in rows)
    total = sum(r.n_tokens for r in rows)
    for name, weight in (("good", 0.9), ("low", 0.05), ("toxic", 0.05)):
        assert sum(r.n_tokens * r[f"p_{name}"] * r.rate for r in rows) == pytest.approx(weight * total, rel=1e-2)


def test_posterior_equals_brute_force(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c d"), (3, "a c \t\n x"), (4, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "good"), (2, "low")], "doc_id long, domain string")
    got = {r.doc_id: r for r in M.mix(docs, labels, {"good": 0.5, "low": 0.5}).collect()}
    counts = {"good": {"a": 2, "b": 1}, "low": {"c": 1, "d": 1}}
    size, every = {"good": 3, "low": 2}, 5

    def log_odds(text):
        out, ws = {}, text.split()
        for d in counts:
            s = 0.0
            for w in ws:
                share = sum(c.get(w, 0) for c in counts.values()) / every
                if share:
                    s += math.log((counts[d].get(w, 0) + share) / (size[d] + 1)) - math.log(share)
            out[d] = math.log(0.5) + s * 200 / (200 + len(ws))
        return out["good"] - out["low"]

    for i, text in ((1, "a b a"), (2, "c d"), (3, "a c x"), (4, "")):
        assert math.log(got[i].p_good / got[i].p_low) == pytest.approx(log_odds(text), abs=1e-9)
    assert got[3].n_tokens == 3 and got[4].n_tokens == 0 and got[4].rate == 1


def test_edge_rows(spark):
    rows = [(1, None, 1), (1, None, 1), (None, "a b", 2), (2, "", None), (3, "w " * 30000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate int")
    labels = spark.createDataFrame([(1, "good"), (3, None), (None, "low"), (3, "low")], "doc_id long, domain string")
    got = M.mix(docs, labels, {"good": 1.0, "low": 1.0}).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 0), (1, 0), (2, 0), (3, 30000)]
    assert len(M.mix(docs, labels.limit(0), {"good": 1.0, "low": 1.0}).collect()) == 5
    assert M.mix(docs.limit(0), labels, {"good": 1.0, "low": 1.0}).collect() == []


def test_no_python_on_executors(spark):
    docs, labels = labelled(spark)
    plan = M.mix(docs, labels, {"good": 0.9, "low": 0.1})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_absent_domain_costs_nothing(spark):
    """A domain that the labels know and the documents lack does not press the others down."""
    good = [f"g{i % 7} h{i % 5} k{i % 3} " * 20 for i in range(60)]
    toxic = [f"g{i % 7} bad{i % 2} k{i % 3} " * 20 for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(good + toxic)), "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, "good") for i in range(60)] + [(60 + i, "toxic") for i in range(20)] + [(1000 + i, "low") for i in range(500)], "doc_id long, domain string"
    )
    got = {r.doc_id: r for r in M.mix(docs, labels, {"good": 0.97, "low": 0.01, "toxic": 0.02}, headroom=1.1).collect()}
    rate = [got[i].rate for i in range(80)]
    assert sum(rate[:60]) / 60 > 1 and min(rate[:60]) > 0.5, rate
    assert sum(rate[60:]) / 20 < 0.5, rate


def test_kept_shares_meet_the_weights(spark):
    """With rates of at most one, the expected tokens kept have the target weights and good documents stay."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(20, 800)), *rng.dirichlet([60, 0.2, 0.2] if i < 1500 else [0.5, 20, 0.5] if i < 1900 else [0.5, 0.5, 20]).tolist()) for i in range(2400)]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    got = {r.doc_id: r.rate for r in M.bounded_rates(members, [0.97, 0.01, 0.02]).collect()}
    rate, tokens = np.array([got[i] for i in range(2400)]), np.array([[r[1] * p for p in r[2:]] for r in rows])
    kept = rate @ tokens
    assert rate.min() >= 0 and rate.max() <= 1 and rate[:1500].mean() > 0.97
    assert np.allclose(kept / kept.sum(), [0.97, 0.01, 0.02], rtol=5e-3), kept / kept.sum()
    # What a draw at these rates keeps, near the weights too.
    drawn = (np.random.default_rng(4).random((50, 2400)) < rate) @ tokens
    assert np.allclose(drawn.sum(0) / drawn.sum(), [0.97, 0.01, 0.02], rtol=0.05)
    # A domain that is not there costs the others nothing.
    less = members.where("doc_id < 1500").withColumns({"p0": F.col("p0") + F.col("p1"), "p1": F.lit(0.0)})
    assert less.count() == 1500 and M.bounded_rates(less, [0.97, 0.01, 0.02]).agg(F.avg("rate")).first()[0] > 0.97
