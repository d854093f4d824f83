"""The manifest against a plain recursive tree; versions against trees built anew."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from scanloom.llm.merkle import BLOCK, FAN, LEVELS, grow, merkle_manifest, nodes, paths, version_nodes, versions
from scanloom.session import settle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + FAN])) for i in range(0, len(out[-1]), FAN)])
    return out


def framed(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) by the contract's words."""
    def low(t):
        return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        trees[lang] = sorted(((r[0] is not None, r[0] or 0), framed(*r), r) for r in groups[lang])
    below = {lang: levels_of([x[1] for x in t]) for lang, t in trees.items()}
    above = levels_of([below[lang][-1][0] for lang in langs])
    out = []
    for at, lang in enumerate(langs):
        for pos, (_, leaf, r) in enumerate(trees[lang]):
            forged = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node, proof = framed(*r[:4], low(r[4])) if forged else leaf, ""
            for tree, i in ((below[lang], pos), (above, at)):
                for level in tree[:-1]:
                    start = i // FAN * FAN
                    left, right = "".join(level[start:i]), "".join(level[i + 1 : start + FAN])
                    node, proof, i = sha(left + node + right), proof + left + right, i // FAN
            out.append((r[0], leaf, below[lang][-1][0], above[-1][0], sha(proof), node, node == above[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_manifest(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["s", None]), rng.choice(["en", "en", "de", "é", None]), rng.choice([3, None]), rng.choice(["Ab", "", None, "É x", "z" * 9000])) for i in range(700)]
    rows += [(None, "s", "en", 1, "A"), (None, "s", "en", 1, "A"), (None, None, None, None, None), (5, "s", "en", 2, "B"), (5, "s", "en", 2, "B"), (6, "q", "one", 1, "One")]
    rows += [(i, "s", "big", 1, f"Text {i}") for i in range(1000, 1000 + BLOCK + 70)]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA + ", pos int, key string, hash string")
    made = merkle_manifest(docs)
    got = sorted((tuple(r)[:7] for r in made.collect()), key=repr)
    assert got == plain(rows)
    assert {r.verified for r in made.where("copied IS NULL").collect()} == {True}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_small_tables(spark, n):
    rows = [(i, "s", "en" if i % 5 else "fr", 1, f"T{i}") for i in range(n)]
    assert sorted((tuple(r)[:7] for r in merkle_manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == plain(rows)


def test_empty_table(spark):
    assert merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_trees(spark):
    rows = [(i, "s", f"lang{i % 90}", 1, f"T{i}") for i in range(200)]
    assert sorted((tuple(r)[:7] for r in merkle_manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == plain(rows)


def test_versions_share_nodes(spark):
    n = BLOCK * FAN + 13  # more levels than two blocks' layers
    assert FAN ** (LEVELS + 1) < n
    hashes = [sha(str(i)) for i in range(n)]
    changed = {0: sha("a"), BLOCK: sha("b"), n - 1: sha("c")}
    leaves = settle(spark.createDataFrame([("k", i, h, changed.get(i)) for i, h in enumerate(hashes)] + [("lone", 0, sha("x"), sha("y"))], "key string, pos long, hash string, new_hash string"))
    tree = grow(leaves)
    own = nodes(tree, leaves)
    assert {(r.level, r.pos): r.hash for r in own.where("key = 'k'").collect()} == {(k, i): h for k, row in enumerate(levels_of(hashes)) for i, h in enumerate(row)}
    made = settle(versions(tree, leaves))
    assert paths(tree).where("key = 'k'").count() == -(-n // BLOCK)
    for pos, new in changed.items():
        want = levels_of([*hashes[:pos], new, *hashes[pos + 1 :]])
        version = made.where((F.col("key") == "k") & (F.col("pos") == pos))
        seen = version_nodes(own, version).collect()
        assert {(r.level, r.pos): r.hash for r in seen} == {(k, i): h for k, row in enumerate(want) for i, h in enumerate(row)}
        assert sum(not r.shared for r in seen) == len(want) and version.first().new_root == want[-1][0]
    lone = made.where("key = 'lone'").first()
    assert (lone.root, lone.new_root, lone.copied, lone.proof) == (sha("x"), sha("y"), [], sha(""))
