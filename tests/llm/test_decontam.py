"""Decontamination against a search for every window."""

import random
import re

import pytest

from llm import decontam

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, window):
    words = split(text)
    hit, found = set(), set()
    for key, item in items:
        terms = split(item)
        size = min(window, len(terms))
        for a in range(len(terms) - size + 1 if terms else 0):
            for i in range(len(words) - size + 1):
                if words[i:i + size] == terms[a:a + size]:
                    hit.update(range(i, i + size))
                    found.add(key)
    return len(words), hit, found


def corpus(seed, window):
    """Texts over few words, so that runs repeat within and between items, with odd rows and short items."""
    rng = random.Random(seed)
    pool = ["a", "b", "É", "日本", "x1", "no", "Ünd", "Zz"]
    line = lambda n: rng.choice([" ", ", ", "-", "\n"]).join(rng.choice(pool) for _ in range(n))
    items = [(1, line(30)), (2, line(window)), (3, line(window - 1)), (4, None), (5, ""), (6, " .,; "), (7, line(25)), (7, line(12)),
             (None, line(window + 3)), (8, "zz " * 40), (9, line(2) + " solo"), (9, line(2) + " solo"), (10, "w" * 500)]
    texts = [None, "", "?!", line(200), line(1), "ZZ zz" * 30, "zz " * 9, "zz " * 50, "w" * 500, "w" * 499, line(5) + " sOLO " + line(5)]
    for _ in range(12):
        parts = [line(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            terms = split(rng.choice(items)[1])
            a = rng.randint(0, len(terms))
            parts += [" ".join(terms[a:a + rng.randint(1, 30)]), line(rng.randint(0, 8))]
        texts.append(" ".join(parts))
    return items, texts + texts[-2:]


@pytest.mark.parametrize("window, block", [(3, 10**6), (4, 25), (10, 40)])
def test_hits_equal_a_search_for_every_window(spark, documents, monkeypatch, window, block):
    """Blocks of a few words make several automata and several passes; pieces of long items overlap."""
    monkeypatch.setattr(decontam, "BLOCK", block)
    monkeypatch.setattr(decontam, "PIECE", 7)
    monkeypatch.setattr(decontam, "CHAIN", 2)
    items, texts = corpus(window, window)
    table = spark.createDataFrame([(k, t, "n") for k, t in items], "item_id bigint, text string, spans string")
    found = {r.doc_id: r for r in decontam.scan(documents(list(enumerate(texts))), table, window=window).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        n, hit, keys = brute(text, items, window)
        marked = {p for s in found[i].spans for p in range(s.start, s.end)}
        assert (found[i].n_words, marked, set(found[i]["items"])) == (n, hit, keys)
        assert found[i].n_hit == len(hit) and len(found[i]["items"]) == len(keys)
        assert all(a.end < b.start for a, b in zip(found[i].spans, found[i].spans[1:]))


def test_longest_match_is_tracked(spark, documents):
    items = spark.createDataFrame([("q", "one two three four five six seven")], "item_id string, text string")
    rows = [(1, "zero one two three four five nine"), (2, "two three four"), (3, "two three five six seven four five six")]
    found = {r.doc_id: r.longest for r in decontam.scan(documents(rows), items, window=3).collect()}
    assert found == {1: 5, 2: 3, 3: 3}


def test_spans_are_cut_and_covered_documents_go(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps")], "item_id int, text string")
    rows = [("a", "Well: THE quick, brown fox — and then the rest of a long enough text stays é.", 1), ("b", "the quick brown fox jumps over", 2),
            ("c", None, 3), ("c", "", 4), ("d", "nothing here", 5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, spans int")
    kept = {r.spans: r.text for r in decontam.decontaminate(docs, items, window=4).collect()}
    assert kept == {1: "Well:  — and then the rest of a long enough text stays é.", 3: None, 4: "", 5: "nothing here"}
    assert decontam.decontaminate(docs, items, window=4).columns == docs.columns


def test_empty_tables_and_long_texts(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id bigint, text string")
    assert decontam.scan(documents([]), some).count() == 0
    assert [tuple(r)[1:] for r in decontam.scan(documents([(1, "a b")]), none).collect()] == [(2, 0, 0, [], [])]
    long = "beta " * 300_000 + "alpha beta gamma delta " + "y" * 2_000_000
    (row,) = decontam.scan(documents([(1, long)]), some).collect()
    assert (row.n_words, row.n_hit, row["items"]) == (300_005, 4, [1])
