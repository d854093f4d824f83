"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from scanloom.llm.spelling_variants import document_words, index_keys, pivots, prefix, probe_keys, spelling_variants, variant_groups


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def words_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7}


def groups(counts, ratio=10):
    out, form = {}, {}
    for w, n in counts.items():
        around = [(-m, v) for v, m in counts.items() if near(w, v)]
        best = min(around, default=None)
        form[w] = (best[1], -best[0]) if best and -best[0] >= ratio * n else (None, None)
        out[w] = len(around)
    def root(w):
        return root(form[w][0]) if form[w][0] else w
    return {(w, form[w][0], root(w), n, out[w], form[w][1]) for w, n in counts.items()}


def ranks_of(words):
    seen = Counter(g for w in words for g in {w[i : i + 2] for i in range(len(w) - 1)})
    return {g: i for i, g in enumerate(sorted(seen, key=lambda g: (seen[g], g)))}


@pytest.mark.parametrize("alphabet, size, seed", [("ab", 8, 1), ("abc", 7, 2), ("abcdef", 12, 3), ("aé", 30, 4), ("xyz", 70, 5)])
def test_every_near_pair_meets(alphabet, size, seed):
    rng = random.Random(seed)
    words = set()
    for _ in range(60):
        w = "".join(rng.choice(alphabet) for _ in range(size + rng.randrange(3)))
        words.add(w)
        for _ in range(4):
            i, c = rng.randrange(len(w)), rng.choice(alphabet)
            words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]))
    ranks = ranks_of(words)
    there, asked = {}, {}
    for w in words:
        grams = prefix(w, ranks)
        there[w], asked[w] = set(index_keys(w, grams)), set(probe_keys(w, pivots(grams)))
    words = sorted(words)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if near(a, b):
                assert asked[a] & there[b] or asked[b] & there[a], (a, b)


def test_pivots_are_the_least_disjoint_pair():
    rng = random.Random(9)
    for _ in range(500):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(4, 14)))
        ranks = {x + y: rng.randrange(1000) for x in "abcd" for y in "abcd"}
        grams = prefix(w, ranks)[:3]
        pairs = [(r + s, p, q) for r, p in grams for s, q in grams if p + 2 <= q]
        got = pivots(grams)
        if pairs:
            cost = {p: r for r, p in grams}
            assert len(got) == 2 and got[1] - got[0] >= 2 and cost[got[0]] + cost[got[1]] == min(pairs)[0]


def test_groups_with_chains_and_ties(spark):
    rng = random.Random(3)
    counts = {"letters": 5000, "lettersx": 400, "lettersxy": 30, "lettersxyz": 2, "zzzzzzza": 20, "zzzzzzzb": 20, "zzzzzzz": 2, "alonealone": 7}
    for _ in range(300):
        counts["".join(rng.choice("abé") for _ in range(rng.randint(7, 10)))] = rng.choice([2, 3, 25, 300, 4000])
    rows = spark.createDataFrame([(w, n, 1) for w, n in counts.items()] + [(None, 3, 1), ("nothing", None, 1)], "word string, n long, form int")
    got = variant_groups(rows).collect()
    assert {tuple(r) for r in got} == groups(counts) and len(got) == len(counts)
    by = {r.word: r for r in got}
    assert by["lettersxyz"].root == "letters" and by["zzzzzzz"].form == "zzzzzzza" and by["alonealone"].root == "alonealone"
    assert variant_groups(rows.limit(0)).collect() == []
    with pytest.raises(ValueError):
        variant_groups(rows, ratio=1)


def test_documents(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdeghÀÿß") for _ in range(rng.randint(6, 11))) for _ in range(25)]
    rows = [(i, " ".join(rng.choice(stems).capitalize() if rng.random() < 0.2 else rng.choice(stems) for _ in range(60)) + ", x1abcdefghi!") for i in range(80)]
    rows += [(None, "nullidword nullidword"), (7, None), (8, ""), (9, "long" * 3000 + " " + "ab " * 5000), (9, "long" * 3000), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, "w", 4) for r in rows], "doc_id long, text string, word string, n int")
    counts = words_of(rows)
    assert {r.word: r.n for r in document_words(docs).collect()} == counts
    got = spelling_variants(docs).collect()
    assert {tuple(r) for r in got} == groups({w: n for w, n in counts.items() if n >= 2})
    assert any(r.form for r in got)
    assert spelling_variants(docs.limit(0)).collect() == []


def test_registered_query(spark, sf):
    from scanloom.llm.queries import op11_spelling_variants

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    counts = {w: n for w, n in words_of(rows).items() if n >= 2}
    variants = {}
    for w in counts:  # brute force by all one-letter deletions, which near words share
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            variants.setdefault(v, set()).add(w)
    around = {w: set() for w in counts}
    for met in variants.values():
        for a in met:
            around[a].update(b for b in met if near(a, b))
    got = {r.word: r for r in op11_spelling_variants(spark, sf).collect()}
    assert set(got) == set(counts)
    for w, r in got.items():
        best = min(((-counts[v], v) for v in around[w]), default=None)
        formed = bool(best) and -best[0] >= 10 * counts[w]
        assert (r.n, r.n_near, r.form, r.form_n) == (counts[w], len(around[w]), best[1] if formed else None, -best[0] if formed else None)
        assert r.root == (got[r.form].root if r.form else w)
