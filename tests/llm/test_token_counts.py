import random

import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from scanloom.llm import token_counts as T
from scanloom.llm.token_counts import PrefixColumns, PrefixCounter, answers, prefix_parts, prefix_table, stored_token_counts, token_counts

PATH = P.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a", "  a", "a  b\n\n c", "\n\n\na", "it's we're they'll 'rex 'r", "!'s ''ll", "<|endoftext|>", "x!<|endoftext|>y<|endoftext|>",
    "<|endof", "éèê ñandú über straße", "日本語 テキスト", "a\x1cb \x85c\xa0d", "🙂🙂 é́", "1234 567,89", "\t\tif x:\r\n        return", "A" * 300, "ab" * 200,
]


@pytest.fixture(scope="module")
def pair():
    return PrefixCounter(PATH), Tokenizer.from_file(PATH)


def brute(lib, text):
    return len(lib.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ODD)
def test_every_prefix(pair, text):
    own, lib = pair
    want = [brute(lib, text[:i]) for i in range(len(text) + 1)]
    assert own.prefixes(text) == want
    assert own.count(text) == want[-1]
    for budget in (0, 1, 2, 3, 5, 8):
        assert own.fit(text, budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_random_texts(pair):
    own, lib = pair
    rng = random.Random(1)
    parts = ["the", " ", "  ", "\n", "'re", "'", "ing", "É", "ü", "12", "!!", "$", "\t", "\u3000", "hello", "<|endoftext|>", "<|", "xq"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        want = [brute(lib, text[:i]) for i in range(len(text) + 1)]
        assert own.prefixes(text) == want, repr(text)
        assert own.count(text) == want[-1]
        budget = rng.randint(0, 12)
        assert own.fit(text, budget) == max(i for i, n in enumerate(want) if n <= budget), repr(text)


def test_columns_equal_single_texts(pair):
    own, lib = pair
    rng = random.Random(8)
    parts = ["the", " ", " ", "  ", "\n", "'re", "ing", "É", "\u3000", "\x1c", "\x85", "hello", "<|endoftext|>", "<|", " a b c d"]
    texts = [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)), " a", "a ", "a b", None]
    columns = PrefixColumns(own)
    for _ in range(2):
        counts, bounds = columns.of(pa.array(["x", *texts, "y"], pa.string())[1:-1])
        assert len(bounds) == len(texts) + 1
        for t, a, b in zip(texts, bounds, bounds[1:]):
            assert counts[a:b].tolist() == own.prefixes(t or "")[1:], repr(t)
    assert columns.of(pa.array(["", ""]))[1].tolist() == [0, 0, 0] and columns.of(pa.array([], pa.string()))[1].tolist() == [0]


def test_stored_parts_answer_any_limit(spark, pair):
    own, _ = pair
    texts = [*ODD, "some words and more of them " * 4, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = T.settle(prefix_parts(docs, PATH))
    for limit in (0, 1, 2, 5, 40, 10_000):
        for r in answers(kept, limit).collect():
            text = texts[r.doc_id] or ""
            assert (r.n_tokens, r.n_bytes) == (own.count(text), len(text.encode()))
            assert r.fit_points == max(i for i, n in enumerate(own.prefixes(text)) if n <= limit), (text, limit)


def test_long_texts_have_several_parts(spark, pair):
    own, lib = pair
    text = "Ünder the  bridge\n" * 900 + "and the words go on " * 300
    docs = spark.createDataFrame([(1, text), (2, text[:4096]), (3, text[:4097])], "doc_id long, text string")
    parts = {(r.doc_id, r.part): r for r in prefix_parts(docs, PATH).collect()}
    assert {k[0]: sum(1 for x in parts if x[0] == k[0]) for k in parts} == {1: -(-len(text) // 4096), 2: 1, 3: 2}
    want = own.prefixes(text)[1:]
    got = [r.base + n for i in range(-(-len(text) // 4096)) for r in [parts[1, i]] for n in r.counts]
    assert got == want and want[-1] == brute(lib, text)
    for limit in (1024, 3000, 6000):
        answered = sorted(tuple(r) for r in stored_token_counts(docs, PATH, limit).collect())
        assert answered == sorted(tuple(r) for r in token_counts(docs, PATH, limit).collect())
        fit = {r[0]: r[4] for r in answered}
        assert fit[1] == max(i for i, n in enumerate(own.prefixes(text)) if n <= limit)


def test_table(spark, sf, pair):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = token_counts(docs, PATH, 200).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.n_tokens == brute(pair[1], texts[r.doc_id]) and r.n_bytes == len(texts[r.doc_id].encode())
        assert r.over_limit == (r.n_tokens > 200)
        assert brute(pair[1], texts[r.doc_id][: r.fit_points]) <= 200


def test_edge_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a b", "y"), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(docs, PATH).collect())
    assert got == [(0, 2), (1, 0), (1, 0), (2, 0)]
    assert token_counts(docs.limit(0), PATH).collect() == []
    assert sorted(len(r.counts) for r in prefix_table(docs, PATH).collect()) == [1, 1, 1, 4]


def test_whole_columns_equal_single_texts(pair):
    """Counts and fits by chunks, and the totals that go on from shared prefixes, equal those of single texts."""
    own, lib = pair
    rng = random.Random(9)
    parts = ["the", " ", " ", "  ", "\n", "'re", "ing", "É", "　", "hello", "<|endoftext|>", "<|", " a b c d", "therein", "é"]
    texts = [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)), None]
    for limit in (0, 1, 4, 9):
        n, fit = PrefixColumns(PrefixCounter(PATH)).whole(pa.array(["x", *texts], pa.string())[1:], limit)
        assert n.tolist() == [brute(lib, t or "") for t in texts]
        assert fit.tolist() == [own.fit(t or "", limit) for t in texts]


def test_apart_equals_merging(pair):
    own, _ = pair
    assert own.plain
    rng, tokens = random.Random(3), [t for t in own.ids if len(t) < 5]
    for left, right in [(rng.choice(tokens), rng.choice(tokens)) for _ in range(3000)] + [(t, t) for t in tokens[:500]]:
        assert own.apart(left, right, 1 << 30) == (own.merge(left + right) == [left, right])
