"""Input tables, and derived inputs written once in SQL both engines accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# column -> (physical type, Spark type) of the given tables
TABLES = {
    "lineitem": {
        "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
        "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
        "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "datetime",
    },
    "orders": {
        "o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "float",
        "o_orderdate": "datetime", "o_orderpriority": "string",
    },
    "part": {
        "p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer",
        "p_retailprice": "float",
    },
    "customer": {
        "c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "float",
        "c_mktsegment": "string",
    },
    "events": {
        "event_id": "integer", "ts": "datetime", "user_id": "integer", "event_type": "string", "value": "float",
        "props": "string",
    },
    "documents": {"doc_id": "integer", "text": "string", "lang": "string", "source": "string", "n_chars": "integer"},
    "pages": {"page_id": "integer", "url": "string", "html": "string"},
    "conversations": {"conv_id": "integer", "turn": "integer", "role": "string", "text": "string"},
    "benchmark": {"item_id": "integer", "text": "string"},
    "labels": {"doc_id": "integer", "quality": "integer", "toxic": "integer"},
    "embeddings": {"vec_id": "integer", "embedding": "nested", "label": "integer"},
}

P = "(l_extendedprice / 1.05e5)"
# every kind of column and every kind of problem, from lineitem
MESSY = {
    "l_orderkey": ("integer", "l_orderkey"),
    "l_linenumber": ("integer", "l_linenumber"),
    "quantity": ("float", "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END"),
    "price": ("float", "l_extendedprice"),
    "net": ("float", "l_extendedprice * (1 - l_discount)"),
    "tail": ("float", f"({P} * {P} * {P} * {P}) * ({P} * {P} * {P} * {P}) * ({P} * {P} * {P} * {P})"),
    "sparse": ("float", "CASE WHEN l_linenumber = 1 THEN l_tax ELSE NULL END"),
    "flag": ("integer", "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END"),
    "constant": ("string", "'same'"),
    "blank": ("string", "CAST(NULL AS STRING)"),
    "returnflag": ("string", "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END"),
    "yes_no": ("string", "CASE WHEN l_linestatus = 'O' THEN 'Yes' ELSE 'No' END"),
    "brand": ("string", "concat('brand ', CAST(l_partkey % 60 AS STRING))"),
    "shipdate": ("datetime", "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_shipdate END"),
    "ship_text": ("string", "CAST(CAST(l_shipdate AS DATE) AS STRING)"),
    "note": ("string", "concat('order ', CAST(l_orderkey AS STRING), ' was shipped in line ', CAST(l_linenumber AS STRING))"),
    "code": ("string", "concat('A', CAST(l_orderkey * 10 + l_linenumber AS STRING))"),
}
DERIVED = {"messy": ("lineitem", MESSY)}


def columns_of(name: str) -> dict[str, str]:
    if name in DERIVED:
        return {c: kind for c, (kind, _) in DERIVED[name][1].items()}
    return TABLES[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived one as a projection over its table."""
    if name not in DERIVED:
        return table(spark, sf_dir, name)
    source, columns = DERIVED[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {c}" for c, (_, e) in columns.items()])


def frame_sql(name: str) -> str:
    if name not in DERIVED:
        return name
    source, columns = DERIVED[name]
    return f"(SELECT {', '.join(f'{e} AS {c}' for c, (_, e) in columns.items())} FROM {source})"
