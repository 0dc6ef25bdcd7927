"""Operators on pairs and whole tables against brute force, and the pipeline."""

import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import bpe, covertree, jaccard, mixing, passages, quality, secrets
from llm.common import components

EDGE = [(None, None), (900, ""), (901, ""), (902, None), (903, "two words"), (904, "two  WORDS"), (904, "two words"), (None, "two words")]


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def _sets(text):
    w = _words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _near(prose):
    """A hot group of near copies, pairs at all distances, and texts that share a passage."""
    rng = np.random.default_rng(5)
    base, passage = prose(1, 120), prose(2, 60)
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 4), replace=False):
            w[at] = f"edit{rng.integers(5)}"
        rows.append((i, " ".join(w)))
    for i in range(60, 110):
        rows.append((i, " ".join(prose(i, 80) + passage + prose(i + 500, 40))))
    for i in range(110, 150):
        w = prose(i // 2, 100)
        w[i % 2 * 50:i % 2 * 55] = []
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("small", [256, 4])
def test_jaccard_join_equals_brute_force(documents, prose, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", small * 4)
    rows = [*EDGE, *_near(prose)]
    sets = [_sets(t) for _, t in rows]
    close = [[i != j and (a == b or bool(a | b) and len(a & b) / len(a | b) >= 0.8) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *[group[j] for j, c in enumerate(row) if c]]) for i, row in enumerate(close)]
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    want = Counter((i, least(rows[k][0] for k, g in enumerate(group) if g == group[n]), sum(close[n]),
                    len({sets[k] for k, c in enumerate(close[n]) if c} - {sets[n]})) for n, (i, _) in enumerate(rows))
    found = Counter((r.doc_id, r.class_id, r.n_links, r.n_linked_texts) for r in jaccard.join(documents(rows)).collect())
    assert found == want
    kept = jaccard.deduplicated(documents(rows))
    assert "cls" in kept.columns and kept.count() == len(set(group))


def test_shingles_are_made_of_few_texts_at_a_time(prose):
    texts = [" ".join(prose(i, 300)) for i in range(400)] * 5
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), *[pa.array(np.arange(n))] * 4], ["text", "doc_id", "code", "want", "copies"])
    assert batch.nbytes > 4 << 20
    for run in (jaccard._signed, jaccard._reread):
        next(run(iter([batch]), 5))
        tracemalloc.start()
        assert sum(part.num_rows for part in run(iter([batch]), 5)) == n
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
        tracemalloc.stop()


def test_runs_reach_the_recall():
    assert jaccard.runs_for(0.8, 0.9999) >= jaccard.runs_for(0.9, 0.9999) >= 1
    assert jaccard.runs_for(0.5, 0.99, 3) > jaccard.runs_for(0.8, 0.99, 3)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(500):
        before = dict(root)
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in found} == root and len(found) == len(root)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_cover_tree_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 60)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 16))
    x = np.concatenate([x, x[:3].repeat(30, 0) + rng.normal(0, 0.12, (90, 16)), x[5:8], x[5:8] * 3.5])
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [float("inf")] + [0.0] * 15),
           (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, rows[10][1]), (11, rows[11][1])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id bigint, embedding array<float>, label int, cls int").repartition(3)
    own = [(i, np.array(v)) for i, v in rows + odd[6:]]
    unit = [v / np.linalg.norm(v) for _, v in own]
    close = np.array([[i != j and len(a) == len(b) and a @ b >= 0.9 for j, b in enumerate(unit)] for i, a in enumerate(unit)])
    group = list(range(len(own)))
    for _ in own:
        group = [min([group[i], *[group[j] for j in np.flatnonzero(row)]]) for i, row in enumerate(close)]
    want = Counter()
    for n, (i, _) in enumerate(own):
        least = min(own[k][0] for k, g in enumerate(group) if g == group[n] and own[k][0] is not None)
        want[i, int(close[n].sum()), least, i == least] += 1
    want.update((i, 0, i, True) for i, _ in odd[:6])
    found = covertree.join(table).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == want
    assert covertree.join(table.limit(0)).count() == 0


def test_spread_blocks_are_compared_without_visiting_their_points_at_every_level(monkeypatch):
    """In many dimensions every point is a node of its own; the pairs found are those of brute force."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 64))
    x = np.concatenate([x, x[:40] + rng.normal(0, 0.3, (40, 64))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    path, levels = covertree.tree(x), []
    covers = covertree._covers
    monkeypatch.setattr(covertree, "_covers", lambda *of: levels.append(of[-1]) or covers(*of))
    assert (covertree.dual(x, path, x, path, 0.9) == (x @ x.T >= 0.9)).all()
    assert len(levels) < 2 * len(covertree.RADII)


def test_tree_covers_and_nests():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    path = covertree.tree(x)
    for level, radius in enumerate(covertree.RADII):
        assert (np.linalg.norm(x - x[path[:, level]], axis=1) <= radius + 1e-9).all()
        assert (path[path[:, level], level] == path[:, level]).all()


def test_compact_windows_tile_all_passages():
    rng = np.random.default_rng(2)
    for high in (8, 1 << 40):
        values = rng.integers(0, high, 120).astype(np.uint64) << np.uint64(20)
        bounds = np.array([0, 50, 50, 53, 120])
        seen = Counter()
        for low, centre, top in zip(*passages.compact_windows(values, bounds, 6)):
            for i in range(low, centre + 1):
                for j in range(centre, top + 1):
                    if j - i + 1 >= 6:
                        seen[i, j] += 1
                        assert values[i:j + 1].min() == values[centre]
        want = {(i, j) for a, b in zip(bounds, bounds[1:]) for i in range(a, b) for j in range(i + 5, b)}
        assert set(seen) == want and set(seen.values()) == {1}


def test_every_repeated_run_of_fifty_words_is_found(documents, prose):
    shared = [prose(k, 55 + 5 * k) for k in range(8)]
    rows = [*EDGE, (800, "x " * 49), (801, " ".join(prose(9999, 3000)))]
    for i in range(60):
        own = prose(1000 + i, 90)
        if i % 3:
            own[30:30] = shared[i % 8]
        rows.append((i, " ".join(own)))
    edited = list(shared[7])
    edited[40] = "other"
    rows.append((70, " ".join(prose(5000, 50) + edited + prose(5001, 50))))
    held = defaultdict(set)
    for i, t in rows:
        w = _words(t)
        for k in range(len(w) - 49):
            held[tuple(w[k:k + 50])].add(i)
    found = {r.doc_id: r for r in passages.deduplicate(documents(rows)).collect() if r.doc_id is not None}
    for i, t in rows:
        w = _words(t)
        again = [k for k in range(len(w) - 49) if len(held[tuple(w[k:k + 50])]) > 1]
        for k in again:
            assert any(s.start <= k and k + 50 <= s.end for s in found[i].spans), (i, k)
        if i is not None and not again and i != 70:
            assert found[i].spans == [] and found[i].n_others == 0 and found[i].first_id == i
    span = found[70].spans[0]
    assert span.start <= 52 and span.end >= 50 + len(edited) - 2
    first = {min(i for i in range(60) if i % 3 and i % 8 == k) for k in range(8) if any(i % 3 and i % 8 == k for i in range(60))}
    assert all(found[i].cuts == [] and found[i].spans for i in first)
    assert passages.deduplicate(documents(rows).limit(0)).count() == 0


def test_passages_with_long_insertions_and_repeated_beginnings(documents, prose):
    """(a) a diagonal that moves by 9 words and more; (b) words that also stand earlier in the other text."""
    rows, want = [], {}
    for k, (n, more) in enumerate([(90, 9), (99, 9), (90, 10), (90, 8)]):
        passage = prose(100 + k, n)
        edited = passage[:n // 2] + prose(200 + k, more) + passage[n // 2:]
        rows += [(2 * k, " ".join(prose(300 + k, 70) + passage + prose(400 + k, 70))),
                 (2 * k + 1, " ".join(prose(500 + k, 70) + edited + prose(600 + k, 70)))]
        want |= {2 * k: (70, 70 + n), 2 * k + 1: (70, 70 + n + more)}
    passage = prose(700, 60)
    rows += [(20, " ".join(prose(701, 70) + passage + prose(702, 70))),
             (21, " ".join(passage[:20] + prose(703, 70) + passage + prose(704, 70)))]
    want |= {20: (70, 130), 21: (90, 150)}
    found = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in passages.deduplicate(documents(rows)).collect()}
    assert found == {i: [span] for i, span in want.items()}


def test_equal_runs_do_not_depend_on_how_many_are_held(monkeypatch):
    rng = np.random.default_rng(3)
    own, other = rng.integers(0, 4, 60).astype(np.uint32), rng.integers(0, 4, 80).astype(np.uint32)
    want = sorted((i, i + n - 1, j, j + n - 1) for i in range(60) for j in range(80)
                  if own[i] == other[j] and not (i and j and own[i - 1] == other[j - 1])
                  for n in [next(k for k in range(1, 82) if i + k == 60 or j + k == 80 or own[i + k] != other[j + k])])
    for points in (1 << 20, 50):
        monkeypatch.setattr(passages, "POINTS", points)
        assert sorted(zip(*(x.tolist() for x in passages.diagonals(own, *passages.ranked(other))))) == want


def _targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in fixed}
        if not rest:
            return fixed
        left = total - sum(fixed.values())
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: most * sizes[s] for s in share if share[s] > most * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


@pytest.mark.parametrize("slots", [1 << 17, 60])
def test_mix_meets_targets(documents, prose, slots):
    rows = [*EDGE, *[(i, " ".join(prose(i, 5 + i % 40))) for i in range(120)]]
    table = documents(rows).withColumn("source", F.when(F.col("doc_id") % 10 == 7, None).when(F.col("doc_id") == 31, "aa")
                                       .when(F.col("doc_id") > 800, "zz").otherwise(F.col("source")))
    mix = mixing.mix(table, slots=slots)
    found = mix.rows.collect()
    assert len(found) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(_targets(sizes)[r.source])
        assert abs(taken[r.source] - r.target) <= 1
    again = mixing.mix(table.repartition(5), slots=slots).rows.collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    # the schedule keeps every source near its share at any time
    order = [r.sid for r in mix.slots.orderBy("slot").collect()]
    share = Counter(order)
    for k in range(1, len(order), 7):
        part = Counter(order[:k])
        assert all(abs(part[s] - k * share[s] / len(order)) <= 3 + 0.1 * k for s in share)
    assert mixing.mix(table.limit(0)).rows.count() == 0


def test_mixed_repeats_documents(documents, prose):
    table = documents([*EDGE, *[(i, " ".join(prose(i, 5 + i % 40))) for i in range(60)]])
    times = {r.doc_id: round(r.taken / r.size + 1e-9) for r in mixing.mix(table).rows.where("size > 0 and doc_id < 100").collect()}
    out = mixing.mixed(table)
    assert out.columns == table.columns
    got = Counter(r.doc_id for r in out.where("doc_id < 100").collect())
    assert {i: n for i, n in times.items() if n} == got


def test_pipeline_equals_brute_force(spark, tmp_path, prose):
    import corpus_pipeline
    rows, labels = [], []
    for i in range(120):
        words = prose(i if i % 6 else 600, 60 + i % 50)
        if i % 5 == 1:
            words += [w.upper() + "!!" for w in prose(i + 900, 80)]
        if i % 7 == 2:
            words[10:10] = ["password=abcdef0123"]
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 0))
        labels.append((i, int(i % 5 != 1), 0))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, table)).collect()}
    left = {i: t for i, t, *_ in rows if scores[i] >= 0.3}
    assert {i for i, *_ in rows if i % 5 != 1} == set(left)
    sets = {i: _sets(t) for i, t in left.items()}
    group = {i: i for i in left}
    for _ in left:
        group = {i: min(group[j] for j in left if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8) for i in left}
    kept = {i: left[i] for i in left if group[i] == i}
    assert len(kept) < len(left)
    clean = {i: t.replace("password=abcdef0123", "[SECRET]") for i, t in kept.items()}
    mixed = mixing.mix(spark.createDataFrame([(i, t, f"s{i % 4}") for i, t in clean.items()], "doc_id bigint, text string, source string"))
    times = {r.doc_id: round(r.taken / r.size + 1e-9) for r in mixed.rows.collect()}
    encoder = bpe.Encoder(corpus_pipeline.VOCABULARY)
    want = Counter()
    for i, t in clean.items():
        want[i, encoder.encode(t)] += times[i]
    found = Counter((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert found == +want


def test_stages_keep_the_columns_of_documents():
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "encode"]
    assert secrets.KINDS[:3] == ["assign", "access", "hex"]


@pytest.mark.parametrize("line", [20, 40, 48])
def test_passages_around_a_common_line_are_found(documents, prose, line):
    """80 pairs of documents share 60 words each, a line of which all of them and some others have."""
    common, rows = prose(901, line), []
    for i in range(80):
        own = prose(1000 + i, 60 - line)
        passage = own[:(60 - line) // 2] + common + own[(60 - line) // 2:]
        for side in (0, 1):
            rows.append((2 * i + side, " ".join([*prose(5000 + 2 * i + side, 70), *passage, *prose(7000 + 2 * i + side, 30)])))
    rows += [(1000 + k, " ".join([*prose(9000 + k, 40), *common, *prose(9500 + k, 40)])) for k in range(20)]
    rows += [(-1, " ".join(["early", *common])), (2000, " ".join([*common, "late"]))]
    found = {r.doc_id: r for r in passages.deduplicate(documents(rows)).collect()}
    hit = [any(s.start <= 70 and s.end >= 130 for s in found[i].spans) for i in range(160)]
    assert sum(hit) >= 0.99 * len(hit)
    assert all(not found[1000 + k].spans for k in range(20))


def test_documents_between_the_smallest_and_largest_of_a_meeting_are_compared(documents, prose):
    """Two near copies of 120 words, among 30 documents that have 40 words of them only, smaller and larger ones."""
    passage = prose(1, 120)
    rows = [(i, " ".join([*prose(100 + i, 40), *passage[40:80], *prose(200 + i, 40)])) for i in [*range(15), *range(50, 65)]]
    for i, edits in ((20, (10, 60)), (21, (100,)), (22, (30, 90))):
        text = list(passage)
        for k in edits:
            text[k] = f"edit{i}x{k}"
        rows.append((i, " ".join([*prose(300 + i, 30), *text, *prose(400 + i, 30)])))
    for most in (2, 8, 100):
        found = defaultdict(set)
        for r in passages.repeats(documents(rows), most=most).collect():
            found[r.doc].add(r.other)
        assert found == {20: {21, 22}, 21: {20, 22}, 22: {20, 21}}


def test_edited_copies_of_a_common_passage_are_found(documents, prose):
    """20 documents each have an edit of their own in the middle of one passage of 60 words, which two others have as it is."""
    passage = prose(1, 60)
    rows = []
    for i in range(22):
        text = list(passage)
        if i not in (7, 15):
            text[25 + i % 10] = f"edit{i}"
        rows.append((i, " ".join([*prose(100 + i, 50), *text, *prose(300 + i, 50)])))
    found = {r.doc_id: r for r in passages.deduplicate(documents(rows)).collect()}
    for i in range(22):
        assert [(s.start, s.end) for s in found[i].spans] == [(50, 110)]


def test_common_tokens_are_bounded(documents, prose, monkeypatch):
    text = " ".join(prose(3, 30))
    rows = [(i, " ".join([text, *prose(100 + i, 40)])) for i in range(40)]
    tokens, classes = passages.common_tokens(documents(rows), often=10)
    assert len(tokens) == 26 and (classes == 3).all()
    assert len(passages.common_tokens(documents(rows), most=20)[0]) <= 20
    monkeypatch.setattr(passages, "HELD", 50)
    assert set(passages.common_tokens(documents(rows), often=10)[0]) <= set(tokens)


def test_all_copies_of_a_text_are_counted(documents, prose):
    """15 copies of a text, one row more of the key of another, and two documents that hold a part of it; 15 copies of another text."""
    text, short = prose(1, 80), " ".join(prose(2, 49))
    rows = [(i, " ".join(text)) for i in range(10, 25)] + [(i, short) for i in range(30, 40)] + [(40, " ".join(text)), (40, " ".join(prose(3, 60)))]
    rows += [(i, " ".join([*prose(100 + i, 30), *text[10:70], *prose(200 + i, 30)])) for i in (5, 50)]
    rows += [(i, " ".join(prose(9, 80))) for i in range(60, 75)]
    found = {r.doc_id: r for r in passages.deduplicate(documents(rows)).collect()}
    assert all(found[i].n_others == 14 and found[i].first_id == 60 for i in range(60, 75))
    for i in [*range(10, 25), 40, 5, 50]:
        assert found[i].n_others == 17 and found[i].first_id == 5
    assert all([tuple(s) for s in found[i].spans] == [(0, 80)] for i in range(10, 25))
    assert [tuple(s) for s in found[10].cuts] == [(10, 70)] and all([tuple(s) for s in found[i].cuts] == [(0, 80)] for i in [*range(11, 25), 40])
    assert [tuple(s) for s in found[50].cuts] == [(30, 90)] and found[5].cuts == []
    assert all(found[i].n_others == 0 and found[i].spans == [] and found[i].first_id == i for i in range(30, 40))


def test_passages_of_two_texts_equal_all_intervals_tried(monkeypatch):
    rng, n_found = np.random.default_rng(4), 0
    for trial in range(150):
        monkeypatch.setattr(passages, "PAIRS", (1 << 20, 32)[trial % 2])
        monkeypatch.setattr(passages, "MANY", (16, 2)[trial % 3 == 0])
        kinds, least, threshold = int(rng.integers(2, 40)), int(rng.integers(3, 14)), (0.5, 0.8)[trial % 2]
        own, other = (rng.integers(0, kinds, int(rng.integers(5, 45))).astype(np.uint32) for _ in range(2))
        half = min(len(own), len(other)) // 2
        other[:half] = own[:half]
        if trial % 3 == 0:
            own = np.sort(own)
        want = []
        a, b, c, d = passages.diagonals(own, *passages.ranked(other))
        for i in range(len(a)):
            for e in np.lexsort((-d, -b)):
                x, y = set(own[a[i]:b[e] + 1].tolist()), set(other[c[i]:d[e] + 1].tolist())
                if (b[e] - a[i] + 1 >= least and d[e] - c[i] + 1 >= least and len(x & y) >= threshold * len(x | y)
                        and not any(p <= a[i] and b[e] <= q and r <= c[i] and d[e] <= s for p, q, r, s in want)):
                    want.append((int(a[i]), int(b[e]), int(c[i]), int(d[e])))
                    break
        if not (len(own) == len(other) and (own == other).all()):
            assert sorted(passages.alike(own, other, least, threshold)) == sorted(want)
            n_found += len(want)
    assert n_found > 200


def test_cells_bound_what_a_task_compares(spark, monkeypatch):
    monkeypatch.setattr(passages, "CELL", 50)
    monkeypatch.setattr(passages, "CELL_DOCS", 20)
    pairs = spark.createDataFrame([(i, j, 0, 9, 0) for i in range(40) for j in range(i)] + [(9, 8, 0, 9, 7)],
                                  "doc bigint, other bigint, low int, high int, home bigint")
    cells = passages._cells(pairs).collect()
    assert sorted((r.doc, r.other) for r in cells if r.home == 0) == sorted((i, j) for i in range(40) for j in range(i))
    sizes = Counter((r.home, r.cell) for r in cells)
    assert len(sizes) > 10 and max(sizes.values()) <= 120 and sizes[7, 0] == 1


def test_meetings_dealt_over_tasks_lose_no_pair(documents, prose, monkeypatch):
    """30 edited copies of a passage in a meeting, whose open documents go to tasks by twos and whose pairs to cells of ten, with no broadcast."""
    passage = prose(1, 100)
    rows = []
    for i in range(30):
        text = list(passage)
        text[20 + i] = f"edit{i}"
        text[60 + i] = f"more{i}"
        rows.append((i, " ".join([*prose(100 + i, 30), *text, *prose(300 + i, 30)])))
    want = {(r.doc, r.other) for r in passages.repeats(documents(rows), most=3).collect()}
    monkeypatch.setattr(passages, "OPEN", 2)
    monkeypatch.setattr(passages, "CELL", 10)
    monkeypatch.setattr(passages, "CELL_DOCS", 10)
    monkeypatch.setattr(passages, "PLACES", 5)
    assert {(r.doc, r.other) for r in passages.repeats(documents(rows), most=3).collect()} == want and len(want) > 100
