"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from llm import prefixes
from llm.queries import _rebuilt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, words int, id string, shard int"


def table(spark, rows, partitions=5):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(partitions)


def turns_of(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said = (role or "", text or "")
            code = hashlib.md5(f"{len(said[0].encode())}:{said[0]}{said[1]}".encode()).digest()
            found[conv].append((turn is not None, turn or 0, code, said))
    return {c: [t[-1] for t in sorted(ts)] for c, ts in found.items()}


def brute(sequences):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
            if d:
                children[tuple(turns[:d - 1])].add(turns[d - 1])
        ends[tuple(turns)].append(conv)
    out = []
    for node, who in members.items():
        below = [m for m in members if m[:len(node)] == node]
        words = {m: len(re.findall("[^\x20\x09-\x0D]+", m[-1][1])) if m else 0 for m in below}
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]),
                    sum(not children[m] for m in below), sum((len(members[m]) - 1) * words[m] for m in below),
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return out


def digest(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    return sorted(map(tuple, rows), key=str)


def dialogues(seed, convs):
    """Many shared first turns, one conversation repeated many times, odd texts, ties and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 10 * convs), convs):
        n = rng.choice([1, 1, 2, 3, 5, 9])
        for t in range(n):
            text = "hot first turn" if t == 0 and rng.random() < 0.5 else rng.choice(["yes", "no no", "", None, "é b\tc"])
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "user", None, "bot"]), text))
    rows += [(10**6 + c, t, "user", f"copy {t}") for c in range(convs) for t in range(3)]
    rows += [(7 * 10**6, 1, "user", "twice"), (7 * 10**6, 1, "user", "twice"), (7 * 10**6, 1, "bot", "tie"), (None, 1, "user", "lost")]
    rows += [(8 * 10**6, t, "user", f"long {t % 3}") for t in range(300)] + [(9 * 10**6, t, "user", f"long {t % 3}") for t in range(200)]
    return rows


@pytest.mark.parametrize("depth, pieces, shards", [(64, 1 << 16, 8), (1, 3, 40), (2, 7, 1)])
def test_nodes_equal_a_dictionary_of_prefixes(spark, monkeypatch, depth, pieces, shards):
    monkeypatch.setattr(prefixes, "DEPTH", depth)
    monkeypatch.setattr(prefixes, "TURNS", pieces)
    monkeypatch.setattr(prefixes, "IDS", pieces)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        rows = dialogues(depth, 40)
        found = prefixes.trie(table(spark, rows))
        assert digest(found) == sorted(brute(turns_of(rows)), key=str)
        assert found.select("node").distinct().count() == found.count()
        assert found.alias("n").join(found.alias("p"), F.expr("n.parent = p.node")).where("p.conv_id <> n.parent_conv_id").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rebuilt_conversations_equal_their_definition(spark):
    rows = dialogues(5, 60)
    own = turns_of(rows)
    swapped = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        swapped[c] = own.get(base, [])[:h] + turns[h:]
    assert any(not s for s in swapped.values())
    assert digest(prefixes.nodes(_rebuilt(prefixes.paths(table(spark, rows))))) == sorted(brute(swapped), key=str)


def test_text_keys_and_empty_tables(spark):
    rows = [("b", 1, "u", "one two"), ("a", 1, "u", "one two"), ("a", 2, "v", "x")]
    convs = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.saved_tokens) for r in prefixes.trie(convs).collect()}
    assert found == {("a", 0): (None, 2, 2), ("a", 1): ("a", 2, 2), ("a", 2): ("a", 1, 0)}
    assert prefixes.trie(convs.limit(0)).count() == 0
    assert prefixes.trie(convs.where("conv_id IS NULL")).count() == 0
