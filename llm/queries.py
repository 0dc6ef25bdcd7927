"""The registered queries of this subpackage: each operator over its whole table, with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import bpe, covertree, decontam, imatch, jaccard, licenses, lmscore, mixing, passages, prefixes, quality, ranked, secrets
from llm.common import saved, shipped, table

# where the public vocabulary lies on every machine
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of good quality. Background: all documents."""
    marks = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = lmscore.score(table(spark, sf_dir, "documents"), marks)
    return found.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of", "n_links", "n_linked_texts")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imatch.edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                        "edited_fingerprint", "near_edited", "near_next")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.deduplicate(table(spark, sf_dir, "documents"))
    words = "aggregate({}, 0L, (n, s) -> n + s.end - s.start)"
    listed = "array_join(transform({}, s -> concat_ws('-', s.start, s.end)), ',')"
    return found.select("doc_id", "n_others", "first_id", F.size("spans").cast("long").alias("n_spans"),
                        F.expr(words.format("spans")).alias("n_repeated_words"), F.expr(words.format("cuts")).alias("n_cut_words"),
                        F.expr(listed.format("spans")).alias("spans"), F.expr(listed.format("cuts")).alias("cuts"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    listed = "array_join(transform(matches, m -> concat_ws(':', m.license, m.start, m.end, round(m.coverage, 4))), ',')"
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"),
                        F.expr("array_join(array_sort(array_distinct(transform(matches, m -> m.license))), ',')").alias("licenses"),
                        F.expr(listed).alias("matches"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    listed = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    base = F.expr(listed.format("filter(spans, s -> s.kind <> 'entropy')"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.expr(listed.format("spans")).alias("spans"))


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.join(table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, decoded=True)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= quality.REJECT_BELOW).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents")).rows
    return found.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked.search(ranked.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


def _rebuilt(found: DataFrame) -> DataFrame:
    """Paths that begin with the first h turns of the conversation at the multiple of 20 below, instead of the first h of their own."""
    heads = found.where("conv % 20 = 0").select(F.col("conv").alias("base"), F.substring("path", 1, 3 * prefixes.DIGEST).alias("head"),
                                                F.substring("words", 1, 3 * prefixes.COUNT).alias("head_words"))
    turns = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    joined = found.withColumn("h", turns.cast("int")).join(heads, F.expr("conv - conv % 20 = base"), "left")
    swapped = "concat(coalesce(substring({0}, 1, h * {2}), X''), substring({1}, h * {2} + 1)) AS {1}"
    return joined.selectExpr("conv", swapped.format("head", "path", prefixes.DIGEST), swapped.format("head_words", "words", prefixes.COUNT))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = saved(prefixes.paths(table(spark, sf_dir, "conversations")), "conversation-paths")
    return prefixes.nodes(_rebuilt(found)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                                  "saved_tokens", "ends_sha256")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = "array_join(array_sort(transform(items, i -> cast(i AS string))), ',')"
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.expr(listed), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _registered(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shipped(spark)
        return query(spark, sf_dir)
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _registered(f) for f in (
        op1_lm_scoring, op2_jaccard_join, op3_fingerprints, op4_substring_dedup, op5_license_scans, op6_secret_scans,
        op7_cover_tree, op8_bpe, op9_quality, op10_mixing, op11_ranked_search, op12_conversation_trie, op13_decontamination)
}

# the mix in closed form: a source's stream is read in a circle until its target is met
ORACLES: dict[str, str] = {
    "op10_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(concat_ws('|', 'mix', doc_id::VARCHAR, text)) AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, most / weight AS ratio, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER earlier, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
    FROM w WINDOW earlier AS (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, coalesce(least(most, weight * (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, sid LIMIT 1)), most) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, round(t.target)::BIGINT AS want,
    (sum(size) OVER (PARTITION BY d.source ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT - size AS begun
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, CASE WHEN size = 0 THEN 0 ELSE
    (want // source_size) * size + greatest(0, least(begun + size, want % source_size) - begun) END::BIGINT AS taken FROM p""",
    "op11_ranked_search": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
n AS (SELECT r, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n FROM d GROUP BY r),
a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
m AS (SELECT r, doc_id, 100 - 50 + (50 * n * docs) // terms AS m FROM n, a),
f AS (SELECT r, term, count(*)::BIGINT AS tf FROM d GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY term), a),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50""",
    "op12_conversation_trie": r"""
WITH t AS (SELECT conv_id, turn, md5(concat(strlen(coalesce(role, '')), ':', role, text)) AS said,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS words FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(said ORDER BY turn NULLS FIRST, said) AS path, list(words ORDER BY turn NULLS FIRST, said) AS words,
        list_reduce([4294967295] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])),
            lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END) AS crc FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, coalesce(b.path[1:c.h], []) || c.path[c.h + 1:] AS path, coalesce(b.words[1:c.h], []) || c.words[c.h + 1:] AS words
    FROM (SELECT *, xor(crc, 4294967295) % 4 AS h FROM c) c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM r),
n AS (SELECT d AS depth, array_to_string(path[1:d], ',') AS node, any_value(path[1:d]) AS path, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs,
        any_value(coalesce(words[nullif(d, 0)], 0)) AS words, list(conv_id ORDER BY conv_id) FILTER (d = len(path)) AS ends FROM p GROUP BY d, node),
k AS (SELECT array_to_string(path[1:depth - 1], ',') AS node, depth - 1 AS depth, count(*)::BIGINT AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0)::BIGINT AS n_children FROM n LEFT JOIN k USING (node, depth)),
u AS (SELECT e AS depth, array_to_string(path[1:e], ',') AS node, sum((n_children = 0)::INT)::BIGINT AS n_leaves,
        sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM m) GROUP BY ALL)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, u.saved_tokens,
    sha256(array_to_string(coalesce(m.ends, []), ',')) AS ends_sha256
FROM m JOIN u ON u.node = m.node AND u.depth = m.depth
LEFT JOIN m q ON q.depth = m.depth - 1 AND q.node = array_to_string(m.path[1:m.depth - 1], ',')""",
    "op13_decontamination": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
windows AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS gram
    FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
runs AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
    FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows))),
met AS (SELECT r, i, size, item FROM runs JOIN windows USING (size, gram)),
hit AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM met) GROUP BY r),
found AS (SELECT r, count(DISTINCT item)::BIGINT AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM met GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)""",
}
