"""Text keys, and extra columns named like those the operators use inside."""

from pyspark.sql import functions as F

from llm import imatch, jaccard, mixing


def test_columns_of_inner_names_are_carried(spark, prose):
    texts = [" ".join(prose(i, 60)) for i in (1, 2, 1)]
    docs = spark.createDataFrame([(i, t, "s", i, "h", "o", 7, 8, 9) for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, source string, _key bigint, _hash string, _source string, _times int, _time int, _code int")
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r._key for r in kept.collect()) == [0, 1]
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and {r._times for r in mixed.collect()} == {7}


def test_fingerprints_of_text_keys(spark, prose):
    texts = [" ".join(prose(i, 40)) for i in range(30)]
    rows = [(f"k{i:02d}", t) for i, t in enumerate(texts)] + [(None, "null key")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    found = {r.doc_id: r for r in imatch.edited_fingerprints(docs).collect()}
    assert len(found) == 31
    order = [None, *sorted(k for k in found if k)]
    for at, k in enumerate(order):
        own, next_ = dict(rows)[k], dict(rows)[order[(at + 1) % len(order)]]
        assert found[k].edited == own[:len(own) - len(own) // 2] + next_[:len(own) // 2]
    ints = spark.createDataFrame([(-1 if k is None else int(k[1:]), t) for k, t in rows], "doc_id bigint, text string")
    same = {r.doc_id: r.fingerprint for r in imatch.edited_fingerprints(ints).collect()}
    assert all(found[k].fingerprint == same[-1 if k is None else int(k[1:])] for k in found)


def test_fresh_names():
    from llm.common import fresh
    assert fresh("_key", ["a"]) == "_key" and fresh("_key", ["_KEY", "__key"]) == "___key"
