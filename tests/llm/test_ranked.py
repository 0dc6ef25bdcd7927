"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm import ranked

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, queries, k):
    terms = [(key, split(text)) for key, text in docs]
    n_docs, n_terms = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    out = []
    for item, text in queries:
        scores = []
        for key, words in terms:
            tf = Counter(words)
            m = 100 - 50 + (50 * len(words) * n_docs) // n_terms if words else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 20 * m))
                        for x in set(split(text)) if tf[x])
            if score > 0:
                scores.append((-score, key is not None, key))
        scores.sort(key=lambda s: s if s[1] else s[:2])
        out += [(item, i + 1, key, -s) for i, (s, _, key) in enumerate(scores[:k])]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    pool = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(2000)] + ["É", "日本", "Hot"]
    line = lambda n: rng.choice([" ", "-", ". "]).join(rng.choice(pool) for _ in range(n))
    docs = [(i, line(rng.choice([1, 5, 5, 5, 40, 120]))) for i in range(n)]
    docs += [(i + n, "hot hot w1 " + docs[0][1]) for i in range(150)]              # copies, so ties
    docs += [(None, "hot w2"), (7, "Hot w2"), (7, "Hot w2"), (10**6, None), (10**6 + 1, ""), (10**6 + 2, " .,"), (10**6 + 3, "w3 " * 20_000 + "w4")]
    queries = [(f"q{i}", line(rng.choice([1, 3, 12]))) for i in range(10)] + [("hot", "HOT hot w2"), ("none", "unseen words"), ("empty", ""), ("null", None), ("w", "w3 w4")]
    return docs, queries


@pytest.mark.parametrize("block, postings, batch, window", [(1024, 1 << 19, 500_000, 64 << 20), (16, 300, 6, 5000)])
def test_ranks_equal_scoring_every_document(spark, documents, monkeypatch, block, postings, batch, window):
    for name, value in (("DOCS", block), ("POSTINGS", postings), ("QUERY_TERMS", batch), ("VISIT", window)):
        monkeypatch.setattr(ranked, name, value)
    docs, queries = corpus(block, 400)
    table = spark.createDataFrame([(k, t, 1, "x") for k, t in queries], "item_id string, text string, rank int, score string")
    found = ranked.search(ranked.build(documents(docs)), table, k=20)
    assert found.columns == ["item_id", "rank", "doc", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, queries, 20)


def test_bounds_spare_visits():
    """A stratum whose bound is below the k-th score is not visited, and what is found stays the same."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 500) for n in rng.integers(1, 400, 600)]
    terms = [split(t) for t in texts]
    import pyarrow as pa

    from llm.words import words
    hashed = words(pa.array(texts), plain=True)
    each, tfs, cuts = ranked.counted(hashed.hashes, hashed.bounds)
    total = sum(map(len, terms))
    strata: dict[int, list] = {}
    for i, t in enumerate(terms):
        a, b = cuts[i], cuts[i + 1]
        strata.setdefault(50 + (50 * len(t) * len(texts)) // total, []).append((i, each[a:b].tobytes(), tfs[a:b].astype("<i4").tobytes()))
    asked = np.unique(each)
    df = np.bincount(np.searchsorted(asked, each), minlength=len(asked))
    weights = np.floor(1000 * np.log((2 * len(texts) + 2) / (2 * df + 1))).astype(np.int64)
    sent = ranked.Batch(["q"], asked, [np.arange(0, len(asked), 41)], weights)
    blocks = []
    for m, held in strata.items():
        row = ranked._block(m, held, pa.int64())
        blocks.append(ranked._Stratum({c: row.column(c)[0].as_py() for c in row.schema.names}, row.column("keys")[0].values, asked, weights))
    few, every = [[]], [[]]
    visits = ranked.visit(blocks, sent, 5, few)
    for block in blocks:
        ranked.visit([block], sent, len(texts), every)
    assert few[0] == every[0][:5]
    assert visits < len(blocks)


def test_empty_tables(spark, documents):
    queries = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert ranked.search(ranked.build(documents([])), queries).count() == 0
    assert ranked.search(ranked.build(documents([(1, None), (2, "")])), queries).count() == 0
    assert ranked.search(ranked.build(documents([(1, "a")])), queries.limit(0)).count() == 0
