"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue import oracle as O
from catalogue.frames import columns_of, frame, frame_sql, table
from colprism.functions import fixed
from colprism.operators import anomalies, boosting, cleaning, clusters, density, evaluate, features, profile, quality, sampling, schema, trees
from colprism.operators.facts import column_facts
from colprism.plans import task as tasks
from colprism.plans import training
from colprism.session import pin, scratch_path, stable
from colprism.sinks import exports
from colprism.sinks.registry import Registry
from colprism.sources import readers, tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query, sql: str | None = None, doubles: list[str] = ()):
    """Registers a query; computed doubles are rounded alike on both sides."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        found = query(spark, sf_dir)
        return found.withColumns({d: F.round(d, 6) for d in doubles}) if doubles else found
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = O.rounded(sql, *doubles)


NUMERIC = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "orders": ["o_custkey", "o_totalprice"],
    "messy": ["l_orderkey", "quantity", "price", "net", "tail", "sparse"],
}
WORDS = {
    "lineitem": ["l_linenumber", "l_returnflag", "l_linestatus"],
    "messy": ["l_linenumber", "flag", "constant", "returnflag", "yes_no", "brand"],
    "part": ["p_name", "p_brand", "p_type"],
}


def on(name: str, operator):
    """A query that applies an operator to one frame."""
    return lambda spark, d: operator(frame(spark, d, name))


def numbered(found: DataFrame) -> DataFrame:
    """A table of a row per column or kind, its rows numbered in the order in which they come."""
    rows = [(at, *row) for at, row in enumerate(pin(found).collect(), start=1)]
    return found.sparkSession.createDataFrame(rows, T.StructType([T.StructField("rank", T.LongType()), *found.schema.fields]))


def facts_of(spark, d, name, **more):
    return pin(column_facts(frame(spark, d, name), **more))


def kinds_of(spark, d, name="messy"):
    """Facts and kinds that the schema and the statistics of a table both read, so distinct values are shuffled once."""
    return pin(schema.with_kinds(column_facts(frame(spark, d, name), moments=True), True))


def stats_of(spark, d, name="messy", facts=None):
    return pin(profile.column_stats(frame(spark, d, name), folded=True, facts=facts))


# -------------------------------------------------------------------- sources

def _orders_csv(spark, d):
    path = scratch_path(spark, "orders") + ".csv"
    table(spark, d, "orders").write.csv(path, header=True, sep=";")
    return path


def _mixed_csv(spark, d):
    """All orders as files of two column orders in one folder."""
    path = scratch_path(spark, "orders") + ".csv"
    orders = table(spark, d, "orders")
    even = F.col("o_orderkey") % 2 == 0
    orders.where(even).write.csv(path, header=True)
    orders.where(~even).select(*reversed(orders.columns)).write.mode("append").csv(path, header=True)
    return path


def _events_json(spark, d):
    path = scratch_path(spark, "events") + ".jsonl"
    micros = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    table(spark, d, "events").write.options(timestampFormat=micros, timestampNTZFormat=micros).json(path)
    return path


add("read_parquet", lambda s, d: readers.read_any(s, f"{d}/part.parquet")[0], "SELECT * FROM part")
add("read_csv", lambda s, d: readers.read_any(s, _orders_csv(s, d))[0], "SELECT * FROM orders")
add("read_csv_folder", lambda s, d: readers.read_any(s, _mixed_csv(s, d))[0], "SELECT * FROM orders")
add("read_json", lambda s, d: readers.read_any(s, _events_json(s, d))[0],
    "SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts) FROM events")
add("meta_separator", lambda s, d: readers.read_any(s, _orders_csv(s, d))[1].withColumn("name", F.lit("orders")),
    "SELECT 'orders' AS name, 'csv' AS format, count(*) AS rows, 6 AS columns, FALSE AS truncated, ';' AS separator FROM orders")
add("preview", lambda s, d: readers.preview(table(s, d, "orders"), 50, ["o_orderkey"]),
    "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate) FROM orders ORDER BY o_orderkey LIMIT 50")


# --------------------------------------------------------------------- ingest

def _untidy(spark, d):
    c = table(spark, d, "customer")
    raw = c.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", F.lit(None).cast("string"))
    return tidy.tidy_columns(raw, [" key ", "", "x", "x", "Unnamed: 4"])


add("tidy_columns", _untidy,
    "SELECT c_custkey AS key, c_name AS column_1, c_nationkey AS x, c_acctbal AS x_2 FROM customer")
add("numbers_from_text", lambda s, d: tidy.numbers_from_text(table(s, d, "lineitem").selectExpr(
    "l_orderkey", "l_linenumber", "CASE WHEN l_linenumber = 3 THEN '  ' ELSE concat(' ', CAST(l_quantity AS STRING)) END AS quantity",
    "concat('00', CAST(l_partkey AS STRING)) AS code")),
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS quantity, "
    "concat('00', CAST(l_partkey AS VARCHAR)) AS code FROM lineitem")
add("dates_from_objects", lambda s, d: tidy.dates_from_objects(table(s, d, "lineitem").selectExpr(
    "l_orderkey", "l_linenumber", "CAST(l_shipdate AS DATE) AS shipped", "CAST(CAST(l_shipdate AS DATE) AS STRING) AS shipped_text")),
    "SELECT l_orderkey, l_linenumber, date_trunc('day', l_shipdate)::TIMESTAMP AS shipped, "
    "date_trunc('day', l_shipdate)::TIMESTAMP AS shipped_text FROM lineitem")
add("fold_categories", on("messy", schema.fold_categories),
    f"SELECT ordinal, name, uniq AS unique, uniq <= least(1000, rows * 0.5) AS folded FROM ({O.facts('messy')}) WHERE phys = 'string'")

# --------------------------------------------------------------------- schema

for _t in ("lineitem", "orders", "part", "customer", "events", "documents", "pages", "conversations", "benchmark", "labels",
           "embeddings", "messy"):
    add(f"infer_schema_{_t}", on(_t, lambda df: schema.infer_schema(df, folded=True).drop("dtype")), O.schema_table(_t))
add("infer_schema_raw", on("messy", lambda df: schema.infer_schema(df).drop("dtype")), O.schema_table("messy", folded=False))
add("column_kind", lambda s, d: schema.with_kinds(facts_of(s, d, "orders"), True).select("name", "unique", "non_null", "kind"),
    f"SELECT name, uniq AS unique, non_null, kind FROM ({O.schema('orders')})")
for _n, _kinds in (("check_numeric", ("integer", "float")), ("check_text", ("string",))):
    # the decision of one branch of the rules, over the columns it is for
    add(_n, lambda s, d, k=_kinds: schema.with_kinds(facts_of(s, d, "messy"), False).where(
        F.col("physical").isin(*k) & (F.col("unique") > 1)).select("name", "kind", "reason"),
        f"SELECT name, kind, reason FROM ({O.schema('messy', folded=False)}) WHERE phys IN {_kinds if len(_kinds) > 1 else '(' + repr(_kinds[0]) + ')'} AND uniq > 1")
add("infer_schema_sampled", on("lineitem", lambda df: schema.infer_schema(df, folded=True, sample_rows=50_000).select("name", "kind")),
    f"SELECT name, kind FROM ({O.schema('lineitem')})")
add("infer_schema_approx", on("messy", lambda df: schema.infer_schema(df, folded=True, distinct="approx").select("name", "kind")))
add("detect_dates", lambda s, d: facts_of(s, d, "messy").where("physical = 'string'").select(
    "name", F.coalesce(schema.detect_dates(), F.lit(False)).alias("dates")),
    f"SELECT name, coalesce(plain < non_null AND dates >= 0.85 * non_null, FALSE) AS dates FROM ({O.facts('messy')}) WHERE phys = 'string'")


def _schema(spark, d, name="messy", facts=None):
    return pin(schema.infer_schema(frame(spark, d, name), folded=True, facts=facts))


_TARGET_ORDER = "CASE kind WHEN 'boolean' THEN 0 WHEN 'categorical' THEN 1 WHEN 'numeric' THEN 2 ELSE 4 END"
add("suggest_targets", lambda s, d: numbered(schema.suggest_targets(_schema(s, d))),
    f"SELECT row_number() OVER (ORDER BY {_TARGET_ORDER}, ordinal) AS rank, name, kind FROM ({O.schema('messy')}) WHERE kind IN ('boolean','categorical','numeric','datetime')")
add("type_composition", lambda s, d: numbered(schema.type_composition(_schema(s, d))),
    f"SELECT row_number() OVER (ORDER BY list_position({fixed.KIND_ORDER!r}, kind)) AS rank, kind, count(*) AS count "
    f"FROM ({O.schema('messy')}) GROUP BY kind")
add("usable_column_count", lambda s, d: schema.usable_column_count(_schema(s, d)),
    f"SELECT count(*) FILTER (modelable) AS usable, count(*) AS columns FROM ({O.schema('messy')})")
add("columns_of_kind", lambda s, d: schema.columns_of_kind(_schema(s, d), "numeric", "datetime"),
    f"SELECT ordinal, name, kind FROM ({O.schema('messy')}) WHERE kind IN ('numeric','datetime')")


def _searched(spark, d):
    facts = kinds_of(spark, d)
    return numbered(schema.search_columns(_schema(spark, d, facts=facts).drop("dtype"), stats_of(spark, d, facts=facts), "e",
                                          ["numeric", "categorical", "text"], "missing", True))


add("search_columns", _searched,
    f"SELECT row_number() OVER (ORDER BY missing_pct DESC, ordinal) AS rank, ordinal, name, kind, reason, modelable, missing_pct, unique_pct FROM ({O.stats('messy', NUMERIC['messy'])}) "
    "WHERE contains(lower(name), 'e') AND kind IN ('numeric','categorical','text')", ["missing_pct", "unique_pct"])

# -------------------------------------------------------------------- profile

_DUPES = {
    "documents": ("text, lang, source, n_chars", ["text", "lang", "source", "n_chars"]),
    "lineitem": ("l_returnflag, l_linestatus, l_shipdate", ["l_returnflag", "l_linestatus", "l_shipdate"]),
}
for _t, (_sql, _cols) in _DUPES.items():
    add(f"duplicate_rows_{_t}", on(_t, lambda df, c=_cols: profile.duplicate_rows(df.select(*c))),
        f"SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_sql} FROM {_t})) AS duplicate_rows FROM {_t}")
add("missing_cells", lambda s, d: profile.missing_cells(facts_of(s, d, "messy")),
    f"SELECT CAST(sum(rows - non_null) AS BIGINT) AS missing_cells, CAST(sum(rows) AS BIGINT) AS cells, "
    f"100.0 * sum(rows - non_null) / sum(rows) AS missing_cells_pct FROM ({O.facts('messy')})", ["missing_cells_pct"])
add("column_report", lambda s, d: profile.column_report(facts_of(s, d, "messy")).drop("dtype"),
    f"SELECT ordinal, name, rows, 100.0 * (rows - non_null) / rows AS missing_pct, uniq AS unique, "
    f"100.0 * uniq / greatest(non_null, 1) AS unique_pct FROM ({O.facts('messy')})", ["missing_pct", "unique_pct"])
for _t, _cols in NUMERIC.items():
    add(f"numeric_stats_{_t}", on(_t, lambda df, c=_cols: profile.numeric_stats(df, c).drop("zeros", "negatives")),
        O.numbers(_t, _cols), O.NUMBER_DOUBLES)
    add(f"histogram_{_t}", on(_t, lambda df, c=_cols: profile.histogram(df, c)), O.histogram(_t, _cols), ["low", "high"])
add("iqr_outliers", on("messy", lambda df: profile.iqr_outliers(df, NUMERIC["messy"])),
    f"SELECT name, q1, median, q3, outliers, outliers_pct FROM ({O.numbers('messy', NUMERIC['messy'])})",
    ["q1", "median", "q3", "outliers_pct"])
add("box_stats", lambda s, d: profile.box_stats(stats_of(s, d)),
    f"SELECT name, min, q1, median, q3, max, greatest(min, q1 - 1.5 * (q3 - q1)) AS low_whisker, "
    f"least(max, q3 + 1.5 * (q3 - q1)) AS high_whisker, mean FROM ({O.numbers('messy', NUMERIC['messy'])})",
    ["min", "q1", "median", "q3", "max", "low_whisker", "high_whisker", "mean"])


def _flagged(spark, d):
    df = frame(spark, d, "lineitem")
    q = profile.quartiles(df, ["l_extendedprice"])["l_extendedprice"]
    return profile.histogram_range_flag(profile.histogram(df, ["l_extendedprice"]), F.lit(q[0]), F.lit(q[2]))


add("histogram_range_flag", _flagged,
    f"SELECT h.*, h.high > q1 AND h.low < q3 AS inside FROM ({O.histogram('lineitem', ['l_extendedprice'])}) h, "
    f"(SELECT q1, q3 FROM ({O.numbers('lineitem', ['l_extendedprice'])}))", ["low", "high"])
for _t, _c in (("orders", "o_orderdate"), ("events", "ts")):
    add(f"datetime_stats_{_t}", on(_t, lambda df, c=_c: profile.datetime_stats(df, [c])),
        f"SELECT '{_c}' AS name, min({_c}) AS first, max({_c}) AS last, "
        f"CAST(floor((epoch_us(max({_c})) - epoch_us(min({_c}))) / 86400000000.0) AS BIGINT) AS span_days FROM {_t}")
    add(f"months_{_t}", on(_t, lambda df, c=_c: profile.months(df, [c])), O.months(_t, _c))
add("month_density", on("orders", lambda df: profile.month_density(profile.months(df, ["o_orderdate"]))),
    f"SELECT *, max(count) OVER () AS peak, count / max(count) OVER () AS share_of_peak FROM ({O.months('orders', 'o_orderdate')})",
    ["share_of_peak"])
for _t, _cols in WORDS.items():
    add(f"category_stats_{_t}", on(_t, lambda df, c=_cols: profile.top_values(df, c)), O.top_values(_t, _cols), ["pct"])
add("balance", lambda s, d: profile.balance(facts_of(s, d, "messy").where(F.col("name").isin(WORDS["messy"]))),
    f"SELECT name, count(*) AS unique, min(count) / max(count) AS balance FROM ({O.counts('messy', WORDS['messy'])}) GROUP BY name",
    ["balance"])
add("top_values_with_other", on("part", lambda df: profile.top_values_with_other(profile.top_values(df, WORDS["part"]))),
    f"WITH t AS (SELECT * FROM ({O.top_values('part', WORDS['part'])}) WHERE rank <= 5) SELECT name, rank, value, pct FROM t UNION ALL "
    "SELECT name, 6, 'all other values', 100 - sum(pct) FROM t GROUP BY name HAVING 100 - sum(pct) > 0.5", ["pct"])
for _t, _c in (("documents", "text"), ("pages", "html")):
    add(f"text_stats_{_t}", lambda s, d, t=_t, c=_c: profile.text_stats(facts_of(s, d, t), [c]),
        f"SELECT '{_c}' AS name, avg(length({_c})) AS avg_length, max(length({_c})) AS max_length FROM {_t}", ["avg_length"])
add("correlations_lineitem", on("lineitem", lambda df: profile.correlations(df, NUMERIC["lineitem"], floor=0.0)),
    O.correlations("lineitem", NUMERIC["lineitem"], 0.0), ["r"])
add("correlations", on("messy", lambda df: profile.correlations(df, NUMERIC["messy"])),
    O.correlations("messy", NUMERIC["messy"], 0.5), ["r"])


def _pairs(spark, d):
    return pin(profile.correlations(frame(spark, d, "messy"), NUMERIC["messy"]))


_PAIRS = O.correlations("messy", NUMERIC["messy"], 0.5)
add("correlation_matrix", lambda s, d: profile.correlation_matrix(_pairs(s, d)),
    f"WITH p AS ({_PAIRS}), m AS (SELECT a, b, r FROM p UNION ALL SELECT b, a, r FROM p UNION ALL "
    "SELECT DISTINCT x, x, 1.0 FROM (SELECT a AS x FROM p UNION SELECT b FROM p)) SELECT a AS column, "
    + ", ".join(f"max(r) FILTER (b = '{c}') AS {c}" for c in ("price", "net", "tail")) + " FROM m GROUP BY a",
    ["price", "net", "tail"])
add("correlation_strength", lambda s, d: profile.correlation_strength(_pairs(s, d)),
    f"SELECT *, CASE WHEN abs(r) >= 0.8 THEN 'strong' ELSE 'moderate' END AS strength, "
    f"CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS sign FROM ({_PAIRS})", ["r"])
add("related_columns", lambda s, d: profile.related_columns(_pairs(s, d), "tail"),
    f"SELECT * FROM ({_PAIRS}) WHERE a = 'tail' OR b = 'tail'", ["r"])
add("missing_matrix", on("messy", lambda df: profile.missing_matrix(df, ["l_orderkey", "l_linenumber"])),
    "SELECT l_orderkey AS key_l_orderkey, l_linenumber AS key_l_linenumber, "
    + ", ".join(f"{c} IS NULL AS {c}" for c in columns_of("messy")) + f" FROM {frame_sql('messy')}")
add("missing_rate", on("messy", profile.missing_rate),
    O.union(f"SELECT '{c}' AS name, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS rate FROM {frame_sql('messy')}"
            for c in columns_of("messy")), ["rate"])
add("missing_pattern", on("messy", lambda df: profile.missing_pattern(df, "quantity", ["l_orderkey", "l_linenumber"])),
    f"SELECT l_orderkey, l_linenumber, quantity IS NULL AS missing FROM {frame_sql('messy')}")
_STATS = O.stats("messy", NUMERIC["messy"])
add("rank_missing", lambda s, d: numbered(profile.rank_missing(stats_of(s, d))),
    f"SELECT row_number() OVER (ORDER BY missing_pct DESC, ordinal) AS rank, name, missing_pct FROM ({_STATS}) WHERE missing_pct > 0 ORDER BY missing_pct DESC, ordinal LIMIT 12", ["missing_pct"])
add("rank_outliers", lambda s, d: numbered(profile.rank_outliers(stats_of(s, d))),
    f"SELECT row_number() OVER (ORDER BY outliers_pct DESC NULLS LAST, ordinal) AS rank, name, outliers, outliers_pct FROM ({_STATS}) WHERE q1 IS NOT NULL", ["outliers_pct"])
add("rank_cardinality", lambda s, d: profile.rank_cardinality(stats_of(s, d)),
    f"SELECT name, kind, uniq AS unique, unique_pct, row_number() OVER (ORDER BY unique_pct DESC, ordinal) AS rank, "
    f"count(*) FILTER (kind = 'categorical' AND uniq > 50) OVER () AS high_cardinality FROM ({_STATS})", ["unique_pct"])
_STAT_COLUMNS = ["min", "max", "mean", "std", "skew", "zeros_pct", "negative_pct", "q1", "median", "q3", "outliers_pct",
                 "missing_pct", "unique_pct"]
add("column_stats", lambda s, d: stats_of(s, d).select(
    "ordinal", "name", "kind", "unique", F.col("outliers").cast("double").alias("outliers"), *_STAT_COLUMNS),
    f"SELECT ordinal, name, kind, uniq AS unique, CAST(outliers AS DOUBLE) AS outliers, {', '.join(_STAT_COLUMNS)} FROM ({_STATS})", _STAT_COLUMNS)
add("profile", lambda s, d: profile.profile(frame(s, d, "messy"), folded=True).summary(),
    f"SELECT count(*) AS rows, {len(columns_of('messy'))} AS columns, count(*) AS sampled_rows, 0 AS duplicate_rows, "
    f"(SELECT 100.0 * sum(rows - non_null) / sum(rows) FROM ({O.facts('messy')})) AS missing_cells_pct FROM lineitem",
    ["missing_cells_pct"])


def _warnings(spark, d, stats=None):
    return profile.warnings(stats_of(spark, d) if stats is None else stats, frame(spark, d, "messy").count())


add("warnings", _warnings, O.warnings(_STATS))
add("sort_warnings", lambda s, d: profile.sort_warnings(_warnings(s, d)), O.warnings(_STATS))

# ------------------------------------------------------------------- quality

_NO_KEYS = ["returnflag", "yes_no", "flag", "shipdate"]


def _copies(spark, d):
    return profile.duplicate_rows(frame(spark, d, "messy").select(*_NO_KEYS)).first()


def _health(spark, d, stats=None, copies=None):
    copies = copies or _copies(spark, d)
    return quality.health_score(stats_of(spark, d) if stats is None else stats, copies["rows"], copies["duplicate_rows"])


_REPEATED = (f"SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_NO_KEYS)} FROM {frame_sql('messy')}))) / count(*) "
             f"FROM {frame_sql('messy')}")
_PARTS = ["completeness", "consistency", "uniqueness", "outliers"]
_HEALTH = O.health(_STATS, _REPEATED)
add("health_score", _health, _HEALTH, _PARTS)
add("grade_missing", lambda s, d: stats_of(s, d).select("name", quality.grade_missing(F.col("missing_pct")).alias("grade")),
    f"SELECT name, CASE WHEN missing_pct >= 40 THEN 'critical' WHEN missing_pct >= 5 THEN 'warning' ELSE 'good' END AS grade FROM ({_STATS})")
add("grade_score", lambda s, d: _health(s, d).select("score", quality.grade_score(F.col("score")).alias("grade")),
    f"SELECT score, CASE WHEN score >= 80 THEN 'good' WHEN score >= 55 THEN 'warning' ELSE 'critical' END AS grade FROM ({_HEALTH})")
add("grade_duplicates", on("documents", lambda df: profile.duplicate_rows(df.select("text")).select(
    "duplicate_rows", quality.grade_duplicates(F.col("duplicate_rows") / F.col("rows") * 100).alias("grade"))),
    "SELECT n AS duplicate_rows, CASE WHEN 100.0 * n / rows >= 5 THEN 'critical' WHEN n > 0 THEN 'warning' ELSE 'good' END AS grade "
    "FROM (SELECT count(*) AS rows, count(*) - count(DISTINCT text) AS n FROM documents)")
_FIXES = O.fixes(_STATS)
add("suggest_fixes", lambda s, d: quality.suggest_fixes(stats_of(s, d)).drop("position"),
    f"SELECT ordinal, \"column\", action, option, label, why FROM ({_FIXES})")


def _shortlist(spark, d):
    stats = stats_of(spark, d)
    return quality.shortlist_fixes(quality.suggest_fixes(stats), profile.warnings(stats, frame(spark, d, "messy").count()))


_LEVEL = "CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"
add("shortlist_fixes", _shortlist,
    f"""WITH s AS MATERIALIZED ({_STATS}), f AS ({O.fixes('SELECT * FROM s')}), w AS ({O.warnings('SELECT * FROM s')}),
    best AS (SELECT * FROM f WHERE action IN ('drop','impute','clip','cast') QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY place) = 1),
    lv AS (SELECT "column", arg_max(level, CASE WHEN issue LIKE '%values are missing' THEN 1 WHEN issue LIKE '%categories, rare%' THEN 2
      WHEN issue LIKE 'heavily%' THEN 3 WHEN issue LIKE '%normal range' THEN 4 ELSE 0 END) AS level FROM w GROUP BY "column")
    SELECT b."column", level, action, option, label, why FROM best b LEFT JOIN lv ON lv."column" = b."column"
    ORDER BY {_LEVEL}, ordinal LIMIT 12""")

RECIPE: list[dict] = []
for _column, _action, _option in (
    ("blank", "drop", None), ("constant", "drop", None), ("sparse", "drop", None), ("quantity", "impute", "mean"),
    ("returnflag", "impute", "mode"), ("tail", "clip", None), ("price", "scale", None), ("note", "cast", "categorical"),
):
    RECIPE = cleaning.stage(RECIPE, _column, _action, _option)


def _projected(spark, d, stats=None):
    return pin(cleaning.project_profile(stats_of(spark, d) if stats is None else stats, cleaning.recipe_table(spark, RECIPE)))


_PROJECTED = O.projected(_STATS)
add("project_profile", lambda s, d: _projected(s, d).select(
    "name", "kind", "missing_pct", F.col("outliers").cast("double").alias("outliers"), "outliers_pct"),
    f"SELECT name, kind, missing_pct, CAST(outliers AS DOUBLE) AS outliers, outliers_pct FROM ({_PROJECTED})", ["missing_pct", "outliers_pct"])


def _diff(spark, d):
    stats, copies = stats_of(spark, d), _copies(spark, d)
    return quality.diff_health(_health(spark, d, stats, copies), _health(spark, d, _projected(spark, d, stats), copies)).select(
        "score_before", "score_after", "score_change", "completeness_change", "outliers_change")


add("diff_health", _diff,
    f"SELECT b.score AS score_before, a.score AS score_after, a.score - b.score AS score_change, "
    f"a.completeness - b.completeness AS completeness_change, a.outliers - b.outliers AS outliers_change "
    f"FROM ({_HEALTH}) b, ({O.health(_PROJECTED, _REPEATED)}) a", ["completeness_change", "outliers_change"])

# ------------------------------------------------------------------- cleaning

_KEYS = "l_orderkey, l_linenumber"
_M = frame_sql("messy")


def messy(*columns):
    return lambda s, d: frame(s, d, "messy").select("l_orderkey", "l_linenumber", *columns)


add("apply_drop", lambda s, d: cleaning.apply_drop(messy("blank", "price")(s, d), ["blank"]),
    f"SELECT {_KEYS}, price FROM {_M}")
add("apply_impute", lambda s, d: cleaning.apply_impute(messy("quantity", "sparse", "returnflag")(s, d), {
    "quantity": "mean", "sparse": "median", "returnflag": "mode"}),
    f"""SELECT {_KEYS}, coalesce(quantity, (SELECT avg(quantity) FROM {_M})) AS quantity,
    coalesce(sparse, (SELECT median(sparse) FROM {_M})) AS sparse, coalesce(returnflag, (SELECT returnflag FROM {_M}
    WHERE returnflag IS NOT NULL GROUP BY returnflag ORDER BY count(*) DESC, returnflag LIMIT 1)) AS returnflag FROM {_M}""",
    ["quantity", "sparse"])
_TAIL = f"(SELECT quantile_cont(tail, 0.25) AS q1, quantile_cont(tail, 0.75) AS q3 FROM {_M})"
add("apply_clip", lambda s, d: cleaning.apply_clip(messy("tail")(s, d), ["tail"]),
    f"SELECT {_KEYS}, greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), tail)) AS tail FROM {_M}, {_TAIL}", ["tail"])
add("apply_log", lambda s, d: cleaning.apply_log(messy("price", "quantity")(s, d), ["price", "quantity"]),
    f"SELECT {_KEYS}, ln(1 + price) AS price, ln(1 + quantity) AS quantity FROM {_M}", ["price", "quantity"])
add("apply_scale", lambda s, d: cleaning.apply_scale(messy("price", "quantity")(s, d), ["price", "quantity"]),
    f"SELECT {_KEYS}, (price - (SELECT avg(price) FROM {_M})) / (SELECT stddev_pop(price) FROM {_M}) AS price, "
    f"(quantity - (SELECT avg(quantity) FROM {_M})) / (SELECT stddev_pop(quantity) FROM {_M}) AS quantity FROM {_M}",
    ["price", "quantity"])
add("apply_encode_one_hot", lambda s, d: cleaning.apply_encode(messy("returnflag")(s, d), "returnflag", "one-hot"),
    f"SELECT {_KEYS}, " + ", ".join(f"CASE WHEN returnflag = '{v}' THEN 1 ELSE 0 END AS returnflag_{v}" for v in "ANR") + f" FROM {_M}")
add("apply_encode_frequency", lambda s, d: cleaning.apply_encode(messy("brand")(s, d), "brand", "frequency"),
    f"SELECT {_KEYS}, count(*) OVER (PARTITION BY brand) / count(*) OVER () AS brand FROM {_M}", ["brand"])
add("apply_cast", lambda s, d: cleaning.apply_cast(messy("flag")(s, d), ["flag"]),
    f"SELECT {_KEYS}, CAST(flag AS VARCHAR) AS flag FROM {_M}")
add("apply_recipe", lambda s, d: cleaning.apply_recipe(frame(s, d, "messy"), RECIPE).select(
    "l_orderkey", "l_linenumber", "quantity", "returnflag", "tail", "price", "note"),
    f"""SELECT {_KEYS}, coalesce(quantity, (SELECT avg(quantity) FROM {_M})) AS quantity,
    coalesce(returnflag, (SELECT returnflag FROM {_M} WHERE returnflag IS NOT NULL GROUP BY returnflag ORDER BY count(*) DESC, returnflag LIMIT 1)) AS returnflag,
    greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), tail)) AS tail,
    (price - (SELECT avg(price) FROM {_M})) / (SELECT stddev_pop(price) FROM {_M}) AS price, note FROM {_M}, {_TAIL}""",
    ["quantity", "tail", "price"])

# ------------------------------------------------------------------- planning


def _tasks(spark, d):
    """Several targets of one table, the task of each."""
    df = frame(spark, d, "messy")
    kinds = schema.kinds_by_name(_schema(spark, d))
    rows = []
    for target in ("flag", "yes_no", "returnflag", "price", "blank", "shipdate", "brand", "nope"):
        try:
            rows.append((target, *tasks.detect_task(df, kinds, target)))
        except ValueError as error:
            rows.append((target, None, str(error)))
    return spark.createDataFrame(rows, "target string, task string, reason string")


add("detect_task", _tasks, f"""SELECT target, CASE WHEN kind IS NULL OR n = 0 THEN NULL WHEN kind = 'boolean' OR n = 2 THEN 'binary_classification'
      WHEN kind IN ('categorical','text','identifier') AND n <= 50 THEN 'multiclass_classification' WHEN kind = 'numeric' THEN 'regression' END AS task,
    CASE WHEN kind IS NULL THEN 'column ''' || target || ''' is not in this dataset' WHEN n = 0 THEN 'column ''' || target || ''' has no values to predict'
      WHEN kind = 'boolean' OR n = 2 THEN 'target has two outcomes'
      WHEN kind IN ('categorical','text','identifier') AND n > 50 THEN 'column ''' || target || ''' has ' || n || ' different values, too many to predict as classes'
      WHEN kind IN ('categorical','text','identifier') THEN 'target has ' || n || ' different classes'
      WHEN kind = 'numeric' THEN 'target is a number, predicting its value'
      ELSE 'column ''' || target || ''' is ' || kind || ' and cannot be predicted' END AS reason
    FROM (SELECT unnest(['flag','yes_no','returnflag','price','blank','shipdate','brand','nope']) AS target) t
    LEFT JOIN (SELECT name, kind, uniq AS n FROM ({O.schema('messy')})) s ON s.name = t.target""")
add("usable_features", lambda s, d: tasks.usable_features(_schema(s, d), "flag"),
    f"""SELECT ordinal, name, CASE WHEN kind = 'numeric' THEN 'numeric' WHEN kind IN ('categorical','boolean') THEN 'categorical'
    WHEN kind = 'datetime' THEN 'temporal' ELSE 'dropped' END AS role, CASE WHEN kind NOT IN ('numeric','categorical','boolean','datetime')
    THEN kind || ' columns are not used as features' END AS why FROM ({O.schema('messy')}) WHERE name <> 'flag'""")
add("target_summary_numeric", on("messy", lambda df: tasks.target_summary(df, "quantity", "regression")),
    f"SELECT 'numeric' AS kind, min(quantity) AS min, max(quantity) AS max, avg(quantity) AS mean, stddev_samp(quantity) AS std FROM {_M}",
    ["mean", "std"])
add("target_summary_classes", on("orders", lambda df: tasks.target_summary(df, "o_orderpriority", "multiclass_classification")),
    "SELECT 'classes' AS kind, count(*) AS classes, min(n) / max(n) AS balance, min(n) / max(n) < 0.2 AS imbalanced FROM "
    "(SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)", ["balance"])
_TOP20 = "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY p_brand ORDER BY count DESC, value LIMIT 20"
add("target_distribution", on("part", lambda df: tasks.target_distribution(df, "p_brand")), _TOP20)
add("target_shares", on("part", lambda df: tasks.target_shares(tasks.target_distribution(df, "p_brand"))),
    f"SELECT *, 100.0 * count / sum(count) OVER () AS pct FROM ({_TOP20}) ORDER BY count DESC, value LIMIT 8", ["pct"])


def _plan(spark, d, name, target, facts=None):
    return tasks.plan(frame(spark, d, name), _schema(spark, d, name, facts), target)


def _reasons(spark, d):
    facts = kinds_of(spark, d)
    return tasks.model_reasons(_plan(spark, d, "messy", "returnflag", facts), stats_of(spark, d, facts=facts),
                               profile.missing_cells(facts).first()["missing_cells_pct"]).select("algorithm", "reason")


add("rank_algorithms", lambda s, d: _plan(s, d, "orders", "o_orderpriority").algorithms_table(s),
    """SELECT position, name, recommended, why FROM (SELECT row_number() OVER (ORDER BY CASE WHEN recommended THEN 0 ELSE 1 END, place) AS position, * FROM (
    SELECT 0 AS place, 'gradient_boosting' AS name, n >= 1000 AS recommended, 'handles mixed column types and missing values, usually the strongest here' AS why FROM (SELECT count(*) AS n FROM orders)
    UNION ALL SELECT 1, 'random_forest', TRUE, 'robust with ' || format('{:,}', n) || ' rows and needs no tuning' FROM (SELECT count(*) AS n FROM orders)
    UNION ALL SELECT 2, 'logistic_regression', n < 1000, 'fast, and the coefficients read as plain per-column effects' FROM (SELECT count(*) AS n FROM orders)
    UNION ALL SELECT 3, 'decision_tree', n < 1000, CASE WHEN n < 1000 THEN 'few rows to learn from, a single tree stays explainable'
      ELSE 'one readable tree, usually beaten by the ensembles on data this size' END FROM (SELECT count(*) AS n FROM orders)))""")


def _plan_table(spark, d):
    p = _plan(spark, d, "messy", "returnflag")
    return spark.createDataFrame([(p.target, p.task, p.task_reason, json.dumps(p.features["numeric"]), p.rows, json.dumps(p.notes))],
                                 "target string, task string, reason string, numeric string, rows bigint, notes string")


add("plan", _plan_table,
    "SELECT 'returnflag' AS target, 'multiclass_classification' AS task, 'target has ' || count(DISTINCT returnflag) || ' different classes' AS reason, "
    "'[\"l_orderkey\", \"quantity\", \"price\", \"net\", \"tail\", \"sparse\"]' AS numeric, count(*) AS rows, '[]' AS notes "
    f"FROM {_M}")
add("model_reasons", _reasons,
    f"""WITH s AS MATERIALIZED ({_STATS}), c AS (SELECT count(*) FILTER (kind IN ('categorical','boolean') AND name <> 'returnflag') AS cat,
      count(*) FILTER (kind = 'numeric') AS num, count(*) FILTER (abs(skew) >= 2) AS skewed, any_value(rows) AS n,
      100.0 * sum(rows - non_null) / sum(rows) AS missing FROM s),
    b AS (SELECT min(k) / max(k) < 0.2 AS uneven FROM (SELECT count(*) AS k FROM {_M} WHERE returnflag IS NOT NULL GROUP BY returnflag)),
    a AS (SELECT unnest(['gradient_boosting','random_forest','logistic_regression','decision_tree']) AS algorithm)
    SELECT algorithm, 'splits on ' || cat || ' categorical feature' || CASE WHEN cat > 1 THEN 's' ELSE '' END || ' without needing scaling' AS reason
      FROM a, c WHERE algorithm <> 'logistic_regression' AND cat > 0
    UNION ALL SELECT algorithm, 'indifferent to the ' || skewed || ' heavily skewed column' || CASE WHEN skewed > 1 THEN 's' ELSE '' END
      FROM a, c WHERE algorithm <> 'logistic_regression' AND skewed > 0
    UNION ALL SELECT algorithm, printf('handles the %.1f%% missing cells natively', missing) FROM a, c WHERE algorithm = 'gradient_boosting' AND missing > 0
    UNION ALL SELECT algorithm, 'scales well past 10k rows with histogram binning' FROM a, c WHERE algorithm = 'gradient_boosting' AND n > 10000
    UNION ALL SELECT algorithm, 'a fast, explainable baseline over ' || num || ' numeric feature' || CASE WHEN num > 1 THEN 's' ELSE '' END
      FROM a, c WHERE algorithm = 'logistic_regression' AND num > 0
    UNION ALL SELECT algorithm, 'depth 6 keeps the tree readable end to end' FROM a WHERE algorithm = 'decision_tree'
    UNION ALL SELECT algorithm, 'trained with balanced class weights for the uneven target' FROM a, b WHERE uneven""")

# ------------------------------------------------------------------- features


def _messy_plan(spark, d):
    return tasks.Plan("returnflag", "multiclass_classification", "", {
        "numeric": ["quantity", "price"], "categorical": ["yes_no"], "temporal": ["shipdate"], "dropped": []}, None, None, [], 0)


add("project_features", lambda s, d: training.project_features(frame(s, d, "messy"), _messy_plan(s, d)),
    f"SELECT quantity, price, yes_no, shipdate, returnflag FROM {_M}")
add("drop_missing_target", lambda s, d: training.drop_missing_target(messy("returnflag")(s, d), "returnflag"),
    f"SELECT {_KEYS}, returnflag FROM {_M} WHERE returnflag IS NOT NULL")
add("numeric_target_filter", lambda s, d: training.numeric_target_filter(
    messy("code")(s, d).withColumn("code", F.expr("CASE WHEN l_linenumber = 1 THEN 'x' ELSE substr(code, 2) END")), "code"),
    f"SELECT {_KEYS}, substr(code, 2) AS code, CAST(substr(code, 2) AS DOUBLE) AS label FROM {_M} WHERE l_linenumber <> 1")


def _roles(spark, d):
    df = frame(spark, d, "orders")
    roles = features.split_features(df, df.columns)
    return spark.createDataFrame([(c, role) for role, cs in roles.items() for c in cs], "name string, role string")


add("split_features", _roles,
    O.union(f"SELECT DISTINCT '{c}' AS name, '{dict(integer='numeric', float='numeric', datetime='temporal').get(k, 'categorical')}' AS role "
            f"FROM orders" for c, k in columns_of("orders").items()))
add("impute_median", lambda s, d: cleaning.apply_impute(messy("quantity")(s, d), {"quantity": "median"}),
    f"SELECT {_KEYS}, coalesce(quantity, (SELECT median(quantity) FROM {_M})) AS quantity FROM {_M}")
add("impute_mode", lambda s, d: cleaning.apply_impute(messy("returnflag")(s, d), {"returnflag": "mode"}),
    f"""SELECT {_KEYS}, coalesce(returnflag, (SELECT returnflag FROM {_M} WHERE returnflag IS NOT NULL GROUP BY returnflag
    ORDER BY count(*) DESC, returnflag LIMIT 1)) AS returnflag FROM {_M}""")
_RARE = ("SELECT props AS value, count(*) AS count, count(*) / sum(count(*)) OVER () AS share, count(*) OVER () AS values FROM events GROUP BY props")
_KEPT = (f"SELECT *, rank <= CASE WHEN n >= 40 THEN 39 ELSE n END AS kept FROM (SELECT *, row_number() OVER (ORDER BY count DESC, value) AS rank, "
         f"count(*) OVER () AS n FROM ({_RARE}) WHERE share >= 0.01)")
add("category_table", on("events", lambda df: features.category_table(df, ["props"])),
    f"SELECT 'props' AS name, value, count, share, kept, rank, values FROM ({_KEPT})", ["share"])
add("one_hot_infrequent", on("events", lambda df: features.one_hot_infrequent(
    df.select("event_id", "props"), "props", features.category_table(df, ["props"]))),
    f"SELECT event_id, props, CASE WHEN props IN (SELECT value FROM ({_KEPT}) WHERE kept) THEN props ELSE 'infrequent' END AS props_bucket FROM events")
add("expand_datetimes", on("events", lambda df: features.expand_datetimes(df.select("event_id", "ts"), ["ts"])),
    "SELECT event_id, CAST(year(ts) AS DOUBLE) AS ts__year, CAST(month(ts) AS DOUBLE) AS ts__month, CAST(day(ts) AS DOUBLE) AS ts__day, "
    "CAST(isodow(ts) - 1 AS DOUBLE) AS ts__weekday, CAST(hour(ts) AS DOUBLE) AS ts__hour, epoch_us(ts) / 1e6 AS ts__epoch FROM events")
add("scale_standard", lambda s, d: cleaning.apply_scale(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]),
    "SELECT o_orderkey, (o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders) AS o_totalprice FROM orders",
    ["o_totalprice"])


def _prepared(spark, d):
    """Mean of every prepared feature: filled, scaled, one-hot, date parts."""
    df = frame(spark, d, "messy").select("quantity", "returnflag", "shipdate")
    fitted = features.prepare_features(df, {"numeric": ["quantity"], "categorical": ["returnflag"], "temporal": ["shipdate"]}, False)
    chosen = [(n, e) for n, e in zip(fitted.names, fitted.expressions) if not n.endswith(("epoch", "day", "hour"))]
    wide = df.agg(*[F.avg(F.expr(e)).alias(n) for n, e in chosen])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("mean")) for n, _ in chosen])))


_MODE = f"(SELECT returnflag FROM {_M} WHERE returnflag IS NOT NULL GROUP BY returnflag ORDER BY count(*) DESC, returnflag LIMIT 1)"
add("build_preprocessor", _prepared, O.union(
    [f"SELECT 'quantity' AS feature, avg(coalesce(quantity, (SELECT median(quantity) FROM {_M}))) AS mean FROM {_M}"]
    + [f"SELECT 'returnflag_{v}', avg(CASE WHEN coalesce(returnflag, {_MODE}) = '{v}' THEN 1.0 ELSE 0.0 END) FROM {_M}" for v in "ANR"]
    + [f"SELECT 'shipdate__{p}', avg(coalesce({p}(shipdate), (SELECT median({p}(shipdate)) FROM {_M}))) FROM {_M}" for p in ("year", "month")]),
    ["mean"])

# -------------------------------------------------------------------- metrics

_ACTUAL = {
    "actual": "o_orderpriority",
    "predicted": "CASE WHEN o_custkey % 3 = 0 THEN '1-URGENT' WHEN o_totalprice > 100000 THEN o_orderpriority ELSE '3-MEDIUM' END",
    "truth": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
    "score": "floor(o_totalprice / 1000) + o_custkey % 7",
    "value": "o_totalprice", "guess": "o_totalprice * 0.9 + (o_custkey % 100) * 10",
}
_A = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in _ACTUAL.items()) + " FROM orders)"


def scored(spark, d):
    return table(spark, d, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _ACTUAL.items()])


_CONFUSION = f"SELECT actual, predicted, count(*) AS count FROM {_A} GROUP BY ALL"
add("confusion", lambda s, d: evaluate.confusion(scored(s, d), "actual", "predicted"), _CONFUSION)
add("confusion_shares", lambda s, d: evaluate.confusion_shares(evaluate.confusion(scored(s, d), "actual", "predicted")),
    f"SELECT *, count / sum(count) OVER (PARTITION BY actual) AS share FROM ({_CONFUSION})", ["share"])
add("classification_metrics", lambda s, d: evaluate.classification_metrics(evaluate.confusion(scored(s, d), "actual", "predicted")),
    O.class_metrics(_CONFUSION), ["accuracy", "balanced_accuracy", "f1"])
add("roc_auc", lambda s, d: evaluate.roc_auc(scored(s, d), "truth", "score"), O.auc(_A), ["roc_auc"])
add("regression_metrics", lambda s, d: evaluate.regression_metrics(scored(s, d), "value", "guess"),
    f"""SELECT 1 - sum((value - guess) * (value - guess)) / (var_pop(value) * count(*)) AS r2, avg(abs(value - guess)) AS mae,
    sqrt(avg((value - guess) * (value - guess))) AS rmse, 100 * avg(abs((value - guess) / value)) FILTER (value <> 0) AS mape_pct,
    count(*) AS test_rows FROM {_A}""", ["r2", "mae", "rmse", "mape_pct"])
add("class_weights", lambda s, d: evaluate.class_weights(scored(s, d), "actual"),
    f"SELECT actual, count(*) AS count, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM {_A} GROUP BY actual", ["weight"])
_CUTS = f"(SELECT unnest(quantile_cont(score, [{', '.join(repr(c) for c in evaluate.CUTS)}])) AS cut FROM {_A})"
add("tune_threshold", lambda s, d: s.createDataFrame(
    [(evaluate.tune_threshold(scored(s, d), "truth", "score"),)], "threshold double"),
    f"""SELECT round(cut, 4) AS threshold FROM (SELECT cut, count(*) FILTER (truth = 1 AND score >= cut) / count(*) FILTER (truth = 1)
    + count(*) FILTER (truth = 0 AND score < cut) / count(*) FILTER (truth = 0) AS recalls FROM {_A}, {_CUTS} GROUP BY cut)
    ORDER BY recalls DESC, cut LIMIT 1""", ["threshold"])
add("predict_at", lambda s, d: evaluate.predict_at(scored(s, d), "score", 120.0).groupBy("truth", "prediction").agg(F.count(F.lit(1)).alias("count")),
    f"SELECT truth, CASE WHEN score >= 120 THEN 1.0 ELSE 0.0 END AS prediction, count(*) AS count FROM {_A} GROUP BY ALL")


def _drawn_sql(columns, copy="0", seed=0):
    """The library's rule for drawing rows: MD5 of the content, then of key, number among equal rows, and seed."""
    text = lambda c: f"coalesce(concat(strlen({c}::VARCHAR), ':', {c}::VARCHAR), '-')"
    key = f"md5(concat({', '.join(text(c) for c in sorted(columns))}))"
    return f"('0x' || substr(md5(concat_ws(':', {key}, {copy}, {seed})), 1, 13))::BIGINT / 4503599627370496.0"


_ORDER_KEYS = ("o_orderkey", "o_custkey", "o_orderpriority")


def _split(spark, d):
    """Every row and its side of a stratified split."""
    drawn = stable(sampling.with_draw(table(spark, d, "orders").select(*_ORDER_KEYS), "u", rule="md5"))
    train, test = evaluate.train_test_split(drawn, 0.2, "u", "o_orderpriority")
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test"))).drop("u")


add("train_test_split", _split,
    f"""WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), w AS (SELECT *, ceil(0.2 * sum(n) OVER ()) AS wanted,
    ceil(0.2 * sum(n) OVER ()) * n / sum(n) OVER () AS exact FROM c),
    t AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY floor(exact) - exact, o_orderpriority)
    <= wanted - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS taken FROM w),
    u AS (SELECT {', '.join(_ORDER_KEYS)}, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_drawn_sql(_ORDER_KEYS)}) AS nth FROM orders)
    SELECT {', '.join(_ORDER_KEYS)}, CASE WHEN nth <= taken THEN 'test' ELSE 'train' END AS side FROM u JOIN t USING (o_orderpriority)""")

_LINE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey")
_FEW_VALUES = ("l_linenumber", "l_returnflag")


def _half(spark, d, columns):
    df = table(spark, d, "lineitem").select(*columns)
    return sampling.sample_frame(df, df.count() // 2, rule="md5")


add("sample_frame", lambda s, d: _half(s, d, _LINE_KEYS),
    f"""SELECT {', '.join(_LINE_KEYS)} FROM (SELECT *, row_number() OVER (ORDER BY {_drawn_sql(_LINE_KEYS, 'copy')}) AS nth FROM
    (SELECT *, row_number() OVER (PARTITION BY {', '.join(_LINE_KEYS)}) - 1 AS copy FROM lineitem))
    WHERE nth <= (SELECT count(*) // 2 FROM lineitem)""")
# rows that stand many times: each copy has a draw of its own
add("sample_repeated", lambda s, d: _half(s, d, _FEW_VALUES).groupBy(*_FEW_VALUES).agg(F.count(F.lit(1)).alias("rows")),
    f"""WITH g AS (SELECT l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_linenumber, l_returnflag) - 1 AS copy FROM lineitem),
    u AS (SELECT *, row_number() OVER (ORDER BY {_drawn_sql(_FEW_VALUES, 'copy')}) AS nth FROM g)
    SELECT l_linenumber, l_returnflag, count(*) AS rows FROM u WHERE nth <= (SELECT count(*) // 2 FROM lineitem) GROUP BY ALL""")
add("cap_rows", lambda s, d: sampling.cap_rows(table(s, d, "orders").select(*_ORDER_KEYS), 1000, rule="md5")[0],
    f"""SELECT {', '.join(_ORDER_KEYS)} FROM (SELECT *, row_number() OVER (ORDER BY {_drawn_sql(_ORDER_KEYS)}) AS nth FROM orders) WHERE nth <= 1000""")
add("cluster_sizes", lambda s, d: evaluate.cluster_sizes(table(s, d, "embeddings"), "label"),
    "SELECT label AS cluster, count(*) AS count FROM embeddings GROUP BY label")
add("cluster_shares", lambda s, d: evaluate.cluster_shares(evaluate.cluster_sizes(table(s, d, "embeddings"), "label")),
    "SELECT label AS cluster, count(*) AS count, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM embeddings GROUP BY label", ["pct"])
add("labels_preview", lambda s, d: evaluate.labels_preview(table(s, d, "embeddings"), ["vec_id"], "label"),
    "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 200")

# --------------------------------------------------------------------- models



def _trained(df, target, algorithms):
    """A run as a user makes it: inferred kinds, the plan for the target, default settings."""
    return training.train(df, tasks.plan(df, pin(schema.infer_schema(df, folded=True)), target), algorithms)


def _run(spark, d, name, target, algorithms):
    return _trained(table(spark, d, name), target, algorithms)


def _fitted(run, spark):
    for r in run.results:
        if not r.ok:
            raise RuntimeError(r.error)
    return run.leaderboard(spark).drop("fit_seconds")


def _board(name, target, algorithms):
    return lambda spark, d: _fitted(_run(spark, d, name, target, algorithms), spark)


for _name in ("ridge", "decision_tree", "random_forest", "gradient_boosting"):
    add("fit_" + _name + ("" if _name == "ridge" else "_regressor"), _board("part", "p_retailprice", [_name]))


def _labelled_documents(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("n_chars", "lang", "source", "quality")


def _quality(algorithm):
    return lambda spark, d: _fitted(_trained(_labelled_documents(spark, d), "quality", [algorithm]), spark)


for _name in ("logistic_regression", "decision_tree", "random_forest", "gradient_boosting"):
    add("fit_" + _name + ("" if _name == "logistic_regression" else "_classifier"), _quality(_name))
add("fit_gradient_boosting_multiclass", _board("orders", "o_orderstatus", ["gradient_boosting"]))


_GRID = ("l_discount", "l_tax", "l_linenumber")


def _grid(spark, d):
    """Lineitems as vectors of three columns of few values, with the quantity as the number to predict."""
    columns = F.array(*[F.col(c).cast("double") for c in _GRID])
    return table(spark, d, "lineitem").select(array_to_vector(columns).alias("features"), F.col("l_quantity").cast("double").alias("label"))


def _first_split(spark, tree, cuts):
    """The split at the root and what it gives."""
    f = tree.feature[0]
    return spark.createDataFrame([(f, float(cuts[f][tree.cut[0]]), tree.value[tree.left[0]], tree.value[tree.right[0]])],
                                 "feature int, cut double, left_value double, right_value double")


def _boosted_stump(spark, d):
    settings = boosting.Settings(boosting.SQUARED, learning_rate=0.5, rounds=1, leaves=2, l2=5.0)
    made = boosting.fit_boosting(_grid(spark, d), settings)
    return _first_split(spark, made.trees[0][0], made.cuts).withColumns(
        {"loss_before": F.lit(made.losses[0][0]), "loss_after": F.lit(made.losses[1][0])})


def _median_stump(spark, d):
    made = trees.AbsoluteTree(1).fit(_grid(spark, d))
    return _first_split(spark, made.tree, made.cuts)


_TALL = " UNION ALL ".join(f"SELECT {i} AS feature, CAST({c} AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) AS y FROM lineitem" for i, c in enumerate(_GRID))
# the best cut of all columns by a search over every one
add("boosting_stump", _boosted_stump,
    f"""WITH t AS ({_TALL}), m AS (SELECT avg(y) AS base FROM t WHERE feature = 0),
    c AS (SELECT feature, x, sum(base - y) AS g, count(*) AS n FROM t, m GROUP BY feature, x),
    w AS (SELECT feature, x AS cut, sum(g) OVER l AS gl, sum(n) OVER l AS nl, sum(g) OVER a AS ga, sum(n) OVER a AS na FROM c
        WINDOW l AS (PARTITION BY feature ORDER BY x), a AS (PARTITION BY feature)),
    b AS (SELECT feature, cut, -0.5 * gl / (nl + 5) AS left_value, -0.5 * (ga - gl) / (na - nl + 5) AS right_value FROM w WHERE nl < na
        ORDER BY gl * gl / (nl + 5) + (ga - gl) * (ga - gl) / (na - nl + 5) - ga * ga / (na + 5) DESC, feature, cut LIMIT 1)
    SELECT b.*, (SELECT avg(0.5 * (y - base) * (y - base)) FROM t, m WHERE feature = 0) AS loss_before,
    (SELECT avg(0.5 * (y - base - CASE WHEN x <= cut THEN left_value ELSE right_value END) ** 2) FROM t, m WHERE t.feature = b.feature) AS loss_after
    FROM b""", ["left_value", "right_value", "loss_before", "loss_after"])
add("absolute_error_stump", _median_stump,
    f"""WITH t AS ({_TALL}), c AS (SELECT DISTINCT feature, x AS cut FROM t),
    s AS (SELECT feature, cut, x <= cut AS low, median(y) AS middle, list(y) AS ys FROM t JOIN c USING (feature) GROUP BY ALL),
    e AS (SELECT feature, cut, low, middle, list_sum(list_transform(ys, lambda y: abs(y - middle))) AS error FROM s)
    SELECT feature, cut, max(middle) FILTER (low) AS left_value, max(middle) FILTER (NOT low) AS right_value FROM e GROUP BY feature, cut
    HAVING count(*) = 2 ORDER BY sum(error), feature, cut LIMIT 1""")


def _importance(spark, d):
    return _run(spark, d, "part", "p_retailprice", ["ridge"]).results[0].importance


add("importances", _importance)


def _permutation(spark, d):
    r = _run(spark, d, "part", "p_retailprice", ["decision_tree"]).results[0]
    from colprism.operators.importance import permutation_importance
    return permutation_importance(r.pipeline, r.holdout, r.used, training.DRAW, regression=True)


add("permutation_importance", _permutation)
add("leaderboard", _board("part", "p_retailprice", ["ridge", "decision_tree"]))


def _vectors(spark, d):
    """The given embeddings as feature vectors."""
    return table(spark, d, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def _part_vectors(spark, d):
    df = table(spark, d, "part")
    fitted = features.prepare_features(df, {"numeric": ["p_size", "p_retailprice"], "categorical": [], "temporal": []}, True)
    return fitted.transform(df).select("p_partkey", "features")


add("fit_kmeans", lambda s, d: evaluate.cluster_sizes(clusters.fit_kmeans(_part_vectors(s, d).persist(), {
    "n_clusters": 4, "n_init": 10, "max_iter": 300})[1]))
add("choose_k", lambda s, d: s.createDataFrame([(clusters.choose_k(_part_vectors(s, d).persist()),)], "k int"))
add("euclidean_silhouette", lambda s, d: s.createDataFrame(
    [(clusters.euclidean_silhouette(_vectors(s, d), "label"),)], "silhouette double"))
add("fit_dbscan", lambda s, d: density.dbscan(_part_vectors(s, d), "p_partkey", 0.08, 8).select("p_partkey", "cluster"),
    """WITH RECURSIVE p AS (SELECT p_partkey AS id, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS x,
        (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS y FROM part),
    near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON b.x BETWEEN a.x - 0.081 AND a.x + 0.081
        WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.08 * 0.08),
    core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 8),
    edge AS MATERIALIZED (SELECT a, b FROM near SEMI JOIN core ca ON ca.id = a SEMI JOIN core cb ON cb.id = b),
    reach(id, name) USING KEY (id) AS (SELECT id, id FROM core UNION
        SELECT e.b, min(r.name) FROM reach r JOIN edge e ON e.a = r.id JOIN recurring.reach k ON k.id = e.b WHERE r.name < k.name GROUP BY e.b),
    joined AS (SELECT id, name FROM reach UNION ALL
        SELECT n.a, min(r.name) FROM near n JOIN reach r ON r.id = n.b ANTI JOIN core c ON c.id = n.a GROUP BY n.a),
    numbered AS (SELECT name, row_number() OVER (ORDER BY count(*) DESC, name) - 1 AS cluster FROM joined GROUP BY name)
    SELECT p.id AS p_partkey, coalesce(cluster, -1)::INT AS cluster FROM p LEFT JOIN joined USING (id) LEFT JOIN numbered USING (name)""")
add("fit_isolation_forest", lambda s, d: anomalies.isolation_forest(_vectors(s, d), "vec_id").select("vec_id", "deviation", "cluster"))
add("strangest_rows", lambda s, d: anomalies.strangest_rows(anomalies.isolation_forest(_part_vectors(s, d), "p_partkey"), ["p_partkey"]))

# ---------------------------------------------------------------------- sinks


def _exported_recipe(spark, d):
    path = scratch_path(spark, "recipe")
    stats = stats_of(spark, d)
    steps = quality.shortlist_fixes(quality.suggest_fixes(stats), _warnings(spark, d, stats)).select("column", "action", "option")
    exports.export_recipe("messy", steps, path)
    return spark.read.schema("dataset string, column string, action string, option string").json(path)


add("export_recipe", _exported_recipe,
    f"SELECT 'messy' AS dataset, \"column\", action, option FROM ({ORACLES['shortlist_fixes']})")


def _exported_schema(spark, d):
    path = scratch_path(spark, "schema")
    df = frame(spark, d, "messy")
    exports.export_schema(readers.meta(df, "messy", "parquet"), _schema(spark, d), path)
    return spark.read.json(path).select("meta.rows", F.explode("schema").alias("c")).select("rows", "c.name", "c.kind", "c.modelable")


add("export_schema", _exported_schema, f"SELECT rows, name, kind, modelable FROM ({O.schema('messy')})")


def _registered(spark, d):
    """Keeps a table, reads it back, and lists what is kept after forgetting another."""
    kept = Registry(spark, scratch_path(spark, "registry"))
    df, meta = readers.read_any(spark, f"{d}/customer.parquet")
    sch = schema.infer_schema(df, folded=True)
    key, gone = kept.register_dataset(df, meta, sch), kept.register_dataset(df, meta, sch)
    kept.forget_dataset(gone)
    rows = kept.load_dataset(key).agg(F.count(F.lit(1)).alias("rows")).first()["rows"]
    listed = kept.list_datasets().agg(F.count(F.lit(1)).alias("datasets")).first()["datasets"]
    return kept.describe_dataset(key)["schema"].select("name", "kind", F.lit(rows).alias("rows"), F.lit(listed).alias("datasets"))


add("register_dataset", _registered, f"SELECT name, kind, rows, 1 AS datasets FROM ({O.schema('customer')})")


def _saved_run(spark, d):
    kept = Registry(spark, scratch_path(spark, "registry"))
    run = _run(spark, d, "part", "p_retailprice", ["ridge"])
    return kept.load_run(kept.save_run("part", run))["leaderboard"].drop("fit_seconds")


add("save_run", _saved_run)


def _exported_results(spark, d):
    path = scratch_path(spark, "results")
    exports.export_results(_run(spark, d, "part", "p_retailprice", ["ridge"]), spark, path)
    return spark.read.json(path).select("algorithm", "ok", "score")


add("export_results", _exported_results)


def _report(spark, d):
    p = _plan(spark, d, "part", "p_retailprice")
    path = scratch_path(spark, "report")
    exports.write_report(spark, exports.training_report("part", p, training.train(table(spark, d, "part"), p, ["ridge"])), path)
    return spark.read.text(path)


add("training_report", _report)


def _replayed(spark, d):
    path = scratch_path(spark, "pipeline")
    run = _run(spark, d, "part", "p_retailprice", ["ridge"])
    manifest = exports.export_pipeline(run, "ridge", path, spark)
    again = exports.replay(spark, path, table(spark, d, "part"))
    return spark.createDataFrame([(manifest["score"], round(again, 4), abs(manifest["score"] - again) <= 0.02)],
                                 "score double, replayed double, same boolean")


add("export_pipeline", _replayed)


def _scored_table(spark, d):
    path = scratch_path(spark, "pipeline")
    exports.export_pipeline(_run(spark, d, "part", "p_retailprice", ["ridge"]), "ridge", path, spark)
    return exports.score_table(spark, path, table(spark, d, "part")).select("p_partkey", "prediction")


add("score_table", _scored_table)
