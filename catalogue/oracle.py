"""The registered queries in DuckDB SQL, written against the tables directly."""

from __future__ import annotations

from itertools import combinations

from catalogue.frames import columns_of, frame_sql

WORDS = "('true','false','yes','no','y','n','t','f','0','1')"


def rounded(sql: str, *doubles: str) -> str:
    """Rounds computed doubles, as the Spark side does."""
    if not doubles:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'round({d}, 6) AS {d}' for d in doubles)}) FROM ({sql})"


def union(parts) -> str:
    return " UNION ALL ".join(parts)


# ---------------------------------------------------------------------- facts

def facts(name: str) -> str:
    """A row of facts per column."""
    parts = []
    for i, (c, kind) in enumerate(columns_of(name).items()):
        number = {"integer": f"CAST({c} AS DOUBLE)", "float": c}.get(kind)
        text = kind == "string"
        nested = kind == "nested"
        parts.append(f"""SELECT {i} AS ordinal, '{c}' AS name, '{kind}' AS phys, count(*) AS rows, count({c}) AS non_null,
            {'0' if nested else f'count(DISTINCT {c})'} AS uniq,
            {f'min({number})' if number else 'CAST(NULL AS DOUBLE)'} AS lo, {f'max({number})' if number else 'CAST(NULL AS DOUBLE)'} AS hi,
            {f"bool_and(lower(trim({c})) IN {WORDS})" if text else 'NULL'} AS words,
            {f"count(*) FILTER (regexp_matches({c}, '^\\s*-?\\d+\\.?\\d*\\s*$'))" if text else '0'} AS plain,
            {f"count(try_cast({c} AS TIMESTAMP))" if text else '0'} AS dates,
            {f'avg(length({c}))' if text else 'NULL'} AS avg_length, {f'max(length({c}))' if text else 'NULL'} AS max_length
            FROM {frame_sql(name)}""")
    return union(parts)


def schema(name: str, folded: bool = True) -> str:
    fold = "phys = 'string' AND uniq <= least(1000, rows * 0.5)" if folded else "FALSE"
    whole = "phys = 'integer' AND non_null = rows"
    rules = [
        ("non_null = 0", "empty", "'no value is available'"),
        ("phys = 'nested'", "unsupported_nested", "'nested values are not analysed'"),
        ("uniq = 1", "constant", "'only one distinct value'"),
        ("phys = 'datetime'", "datetime", "'stored as date time'"),
        (fold, "categorical", "format('{:,}', uniq) || ' different values'"),
        ("phys IN ('integer','float') AND uniq = 2 AND lo = 0 AND hi = 1", "boolean", "'only 0 and 1'"),
        (f"{whole} AND uniq = non_null AND rows > 20", "identifier", "'each row has a different integer'"),
        (f"{whole} AND uniq <= 10", "categorical", "'integer with only ' || uniq || ' different values'"),
        ("phys IN ('integer','float')", "numeric", "format('{:,}', uniq) || ' different numeric values'"),
        ("uniq <= 2 AND words", "boolean", "'reads as true/false'"),
        ("plain < non_null AND dates >= 0.85 * non_null", "datetime", "'date-time value'"),
        ("uniq <= 0.5 * non_null AND uniq <= 200", "categorical",
         "format('{:,}', uniq) || ' different values in ' || format('{:,}', non_null) || ' rows'"),
        ("avg_length >= 25", "text", "'free text, about ' || CAST(floor(avg_length) AS BIGINT) || ' characters long'"),
    ]
    kind = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, k, _ in rules) + " ELSE 'identifier' END"
    reason = "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, _, r in rules) + \
        " ELSE format('{:,}', uniq) || ' different values, almost one per row' END"
    return (f"SELECT *, kind IN ('numeric','categorical','boolean','datetime') AS modelable FROM "
            f"(SELECT *, {kind} AS kind, {reason} AS reason FROM ({facts(name)}))")


def schema_table(name: str, folded: bool = True) -> str:
    return f"SELECT ordinal, name, kind, reason, modelable FROM ({schema(name, folded)})"


# -------------------------------------------------------------------- numbers

def numbers(name: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS name, min({x}) AS min, max({x}) AS max, avg({x}) AS mean, stddev_pop({x}) AS std,
            skewness({x}) AS skew, 100.0 * count(*) FILTER ({c} = 0) / count({c}) AS zeros_pct,
            100.0 * count(*) FILTER ({c} < 0) / count({c}) AS negative_pct,
            any_value(q1) AS q1, any_value(q2) AS median, any_value(q3) AS q3,
            count(*) FILTER ({x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)) AS outliers,
            100.0 * count(*) FILTER ({x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)) / count({c}) AS outliers_pct
            FROM {frame_sql(name)} t, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2,
            quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {frame_sql(name)})""")
    return union(parts)


NUMBER_DOUBLES = ["min", "max", "mean", "std", "skew", "zeros_pct", "negative_pct", "q1", "median", "q3", "outliers_pct"]


def histogram(name: str, columns: list[str], bins: int = 20) -> str:
    parts = []
    for c in columns:
        parts.append(f"""
        SELECT '{c}' AS name, b AS bin, lo + b * step AS low, CASE WHEN b = n - 1 THEN hi ELSE lo + (b + 1) * step END AS high,
          (SELECT count(*) FROM {frame_sql(name)} WHERE CAST({c} AS DOUBLE) >= lo + b * step
             AND (CAST({c} AS DOUBLE) < lo + (b + 1) * step OR b = n - 1)) AS count
        FROM (SELECT *, (hi - lo) / n AS step FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi,
            least({bins}, count(DISTINCT {c})) AS n FROM {frame_sql(name)})) r, (SELECT CAST(range AS INT) AS b FROM range({bins})) g
        WHERE b < n""")
    return union(parts)


# ---------------------------------------------------------------------- words

def value_text(c: str, kind: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if kind == "datetime" else f"CAST({c} AS VARCHAR)"


def counts(name: str, columns: list[str]) -> str:
    kinds = columns_of(name)
    return union(f"SELECT '{c}' AS name, {value_text(c, kinds[c])} AS value, count(*) AS count FROM {frame_sql(name)} "
                 f"WHERE {c} IS NOT NULL GROUP BY ALL" for c in columns)


def top_values(name: str, columns: list[str], limit: int = 8) -> str:
    return (f"SELECT name, rank, value, count, pct FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY count DESC, value) AS rank, "
            f"100.0 * count / sum(count) OVER (PARTITION BY name) AS pct FROM ({counts(name, columns)})) WHERE rank <= {limit}")


def months(name: str, column: str) -> str:
    return (f"SELECT '{column}' AS name, strftime({column}, '%Y-%m') AS month, count(*) AS count FROM {frame_sql(name)} "
            f"WHERE {column} IS NOT NULL GROUP BY ALL ORDER BY month LIMIT 36")


def correlations(name: str, columns: list[str], floor: float, limit: int = 25) -> str:
    pairs = union(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {frame_sql(name)}" for a, b in combinations(columns, 2))
    return f"SELECT * FROM ({pairs}) WHERE abs(r) >= {floor} ORDER BY abs(r) DESC LIMIT {limit}"


# ---------------------------------------------------------------- whole report

def kinds_sql(name: str, folded: bool, *kinds: str) -> str:
    return f"SELECT name FROM ({schema(name, folded)}) WHERE kind IN ({', '.join(repr(k) for k in kinds)})"


def stats(name: str, numeric: list[str], folded: bool = True) -> str:
    """The columns of a profile that rules read."""
    return (f"SELECT s.*, 100.0 * (rows - non_null) / rows AS missing_pct, 100.0 * uniq / greatest(non_null, 1) AS unique_pct, "
            f"n.min, n.max, n.mean, n.std, n.skew, n.zeros_pct, n.negative_pct, n.q1, n.median, n.q3, n.outliers, n.outliers_pct "
            f"FROM ({schema(name, folded)}) s LEFT JOIN ({numbers(name, numeric)}) n ON n.name = s.name AND s.kind = 'numeric'")


def warnings(stats_sql: str) -> str:
    rules = [
        ("kind = 'empty'", "high", "'column is completely empty'"),
        ("kind = 'constant'", "medium", "'same value in every row, carries no signal'"),
        ("kind = 'identifier'", "medium", "'looks like an id, will be excluded from models'"),
        ("missing_pct >= 40", "high", "printf('%.0f%% of values are missing', missing_pct)"),
        ("kind = 'categorical' AND uniq > 50", "medium", "format('{:,}', uniq) || ' categories, rare ones will be grouped together'"),
        ("kind = 'numeric' AND abs(skew) >= 3", "low", "'heavily skewed, a log transform may help'"),
        ("kind = 'numeric' AND outliers_pct >= 5", "low", "printf('%.0f%% of values sit outside the normal range', outliers_pct)"),
    ]
    return union(f"SELECT ordinal, name AS column, '{level}' AS level, {text} AS issue FROM ({stats_sql}) WHERE {rule}"
                 for rule, level, text in rules)


def health(stats_sql: str, duplicates: str) -> str:
    c = "greatest(0, least(100, {}))".format
    parts = (f"SELECT {c('100 - avg(missing_pct)')} AS completeness, "
             f"{c("100 - 100.0 * count(*) FILTER (kind IN ('empty','constant')) / count(*)")} AS consistency, "
             f"{c(f'100 - 200.0 * ({duplicates})')} AS uniqueness, "
             f"{c("100 - 4 * coalesce(avg(outliers_pct) FILTER (kind = 'numeric'), 0)")} AS outliers FROM ({stats_sql})")
    return (f"SELECT *, CAST(floor(0.4 * completeness + 0.2 * consistency + 0.2 * uniqueness + 0.2 * outliers + 0.5) AS INT) AS score "
            f"FROM ({parts})")


def fixes(stats_sql: str) -> str:
    how = "CASE WHEN kind = 'numeric' THEN CASE WHEN abs(skew) >= 1 THEN 'median' ELSE 'mean' END ELSE 'mode' END"
    gaps = "printf('fills %.1f%% gaps', missing_pct)"
    rules = [
        ("kind = 'empty'", "drop", "NULL", "'Drop column'", "'it has no values at all'"),
        ("kind = 'constant'", "drop", "NULL", "'Drop column'", "'the same value in every row carries no signal'"),
        ("kind = 'identifier'", "drop", "NULL", "'Drop column'", "'ids are unique per row and never generalise'"),
        ("kind NOT IN ('empty','constant') AND missing_pct >= 60", "drop", "NULL", "'Drop column'",
         "printf('%.0f%% missing is too much to fill in honestly', missing_pct)"),
        ("kind NOT IN ('empty','constant') AND missing_pct > 0 AND missing_pct < 60", "impute", how, f"'Impute with ' || {how}",
         f"{gaps} || CASE {how} WHEN 'median' THEN '; median because the column is skewed' "
         f"WHEN 'mode' THEN ' with the most common value' ELSE ' with the average' END"),
        ("kind = 'numeric' AND abs(skew) >= 2 AND min >= 0", "log", "NULL", "'Log-transform'",
         "printf('skew of %.1f squashes most values into a few bins', skew)"),
        ("kind = 'numeric' AND outliers_pct >= 2", "clip", "NULL", "'Clip outliers'",
         "printf('%.1f%% of values sit beyond 1.5 × IQR', outliers_pct)"),
        ("kind = 'numeric'", "scale", "NULL", "'Standardise'", "'linear models and k-means need features on one scale'"),
        ("kind IN ('categorical','boolean') AND uniq > 20", "encode", "'frequency'", "'Frequency-encode'",
         "uniq || ' categories would explode into as many columns'"),
        ("kind IN ('categorical','boolean') AND uniq <= 20", "encode", "'one-hot'", "'One-hot encode'",
         "uniq || ' categories become ' || uniq || ' indicator columns'"),
        ("kind = 'text' AND unique_pct < 5", "cast", "'categorical'", "'Cast to categorical'",
         "'only ' || uniq || ' distinct values -- it behaves like a category'"),
    ]
    return union(f"SELECT ordinal, name AS column, {i} AS place, '{a}' AS action, CAST({o} AS VARCHAR) AS option, {label} AS label, "
                 f"{why} AS why FROM ({stats_sql}) WHERE {rule}" for i, (rule, a, o, label, why) in enumerate(rules))


def projected(stats_sql: str) -> str:
    """The messy recipe of the catalogue, projected onto the statistics."""
    return (f"SELECT * REPLACE (CASE WHEN name IN ('quantity','returnflag') THEN 0.0 ELSE missing_pct END AS missing_pct, "
            f"CASE WHEN name = 'tail' THEN 0 ELSE outliers END AS outliers, "
            f"CASE WHEN name = 'tail' THEN 0.0 ELSE outliers_pct END AS outliers_pct, "
            f"CASE WHEN name = 'note' THEN 'categorical' ELSE kind END AS kind) "
            f"FROM ({stats_sql}) WHERE name NOT IN ('blank','constant','sparse')")


# -------------------------------------------------------------------- metrics

def per_class(table: str) -> str:
    return (f"SELECT label, sum(a) AS a, sum(p) AS p, sum(hit) AS hit FROM (SELECT actual AS label, count AS a, 0 AS p, "
            f"CASE WHEN actual = predicted THEN count ELSE 0 END AS hit FROM ({table}) "
            f"UNION ALL SELECT predicted, 0, count, 0 FROM ({table})) GROUP BY label")


def class_metrics(table: str) -> str:
    return (f"SELECT sum(hit) / sum(a) AS accuracy, avg(hit / a) FILTER (a > 0) AS balanced_accuracy, "
            f"sum(CASE WHEN a + p > 0 THEN 2.0 * hit / (a + p) ELSE 0 END * a) / sum(a) AS f1, CAST(sum(a) AS BIGINT) AS test_rows "
            f"FROM ({per_class(table)})")


def auc(scored: str) -> str:
    """Rank formula with mean ranks for ties; ``scored`` has truth and score."""
    return (f"SELECT (sum(r) FILTER (truth = 1) - p * (p + 1) / 2.0) / (p * n) AS roc_auc FROM (SELECT truth, "
            f"rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r, "
            f"count(*) FILTER (truth = 1) OVER () * 1.0 AS p, count(*) FILTER (truth = 0) OVER () * 1.0 AS n FROM ({scored})) GROUP BY p, n")
