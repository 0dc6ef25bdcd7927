"""Feature preparation: fitted on the training rows, applied as plain SQL.

Fitting needs a few aggregates (medians, modes, category shares, moments).
The result is a list of SQL expressions, one per feature, so applying it is a
projection Catalyst compiles, and a saved pipeline needs nothing but Spark.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colprism.functions import fixed
from colprism.functions.columns import as_number, as_timestamp, col, finite, nan_to_null, physicals, quoted
from colprism.operators.facts import number_facts
from colprism.operators.profile import quartiles, value_counts

SCALED = {"logistic_regression", "ridge", "kmeans", "dbscan"}
DATE_PARTS = ["year", "month", "day", "weekday", "hour", "epoch"]
RARE = "infrequent"


def split_features(df: DataFrame, columns: list[str], kinds: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Columns by how they are encoded.

    By kind when kinds are given; otherwise by physical type: timestamps,
    numbers, and everything else as categories.
    """
    by_type = physicals(df)
    out: dict[str, list[str]] = {"numeric": [], "categorical": [], "temporal": []}
    for c in columns:
        if kinds is not None:
            role = {"numeric": "numeric", "datetime": "temporal"}.get(kinds[c], "categorical")
        else:
            role = {"datetime": "temporal", "integer": "numeric", "float": "numeric"}.get(by_type[c], "categorical")
        out[role].append(c)
    return out


def expand_datetimes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Year, month, day, weekday (Monday 0), hour and epoch seconds; missing stays missing."""
    kinds = physicals(df)
    parts = []
    for c in columns:
        ts = as_timestamp(c, kinds[c])
        made = [F.year(ts), F.month(ts), F.dayofmonth(ts), F.weekday(ts), F.hour(ts), F.unix_micros(ts) / F.lit(1e6)]
        parts += [m.cast("double").alias(f"{c}__{p}") for m, p in zip(made, DATE_PARTS)]
    return df.select(*[col(c) for c in df.columns if c not in columns], *parts)


def category_table(df: DataFrame, columns: list[str], min_share: float = fixed.RARE_SHARE,
                   max_columns: int = fixed.MAX_CATEGORIES) -> DataFrame:
    """Frequency of every category and whether it keeps a column of its own.

    A category needs ``min_share`` of the rows; at most ``max_columns``
    columns come out, one of them for the rare rest if there is any.
    """
    counted = value_counts(df, columns)
    total = Window.partitionBy("name")
    frequent = F.col("count") >= F.lit(min_share) * F.col("total")
    rank = F.row_number().over(total.orderBy(F.desc("count"), F.asc("value")))
    # the cut to max_columns needs ranks among the frequent ones only, of which
    # there are at most 1 / min_share, so the ranked group is bounded
    totals = counted.groupBy("name").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("values"))
    common = counted.join(F.broadcast(totals), "name").where(frequent).withColumn("rank", rank)
    n_common = F.count(F.lit(1)).over(total)
    room = F.when(n_common >= max_columns, max_columns - 1).otherwise(n_common)
    return (common.withColumn("kept", F.col("rank") <= room)
            .select("name", "value", "count", (F.col("count") / F.col("total")).alias("share"), "kept", "rank", "values"))


def one_hot_infrequent(df: DataFrame, column: str, categories: DataFrame) -> DataFrame:
    """The column with every category that keeps no column folded into one bucket."""
    kept = categories.where((F.col("name") == column) & F.col("kept")).select(F.col("value").alias("_kept"))
    # at most 40 kept values
    return (df.withColumn("_text", col(column).cast("string")).join(F.broadcast(kept), F.col("_text") == F.col("_kept"), "left")
            .withColumn(f"{column}_bucket", F.when(F.col("_text").isNull(), None).otherwise(F.coalesce("_kept", F.lit(RARE))))
            .drop("_text", "_kept"))


@dataclass
class Prepared:
    """A fitted preparation: names, source columns and SQL of every feature."""
    columns: dict[str, list[str]]
    scaled: bool
    names: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    expressions: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)

    def stages(self) -> list:
        """Pipeline stages that add the feature vector and nothing else."""
        temporary = [f"__f{i}" for i in range(len(self.expressions))]
        made = ", ".join(f"{e} AS {t}" for e, t in zip(self.expressions, temporary))
        return [
            SQLTransformer(statement=f"SELECT *, {made} FROM __THIS__"),
            VectorAssembler(inputCols=temporary, outputCol="features", handleInvalid="error"),
            SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(temporary)}) FROM __THIS__"),
        ]

    def transform(self, df: DataFrame) -> DataFrame:
        return PipelineModel(self.stages()).transform(df)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number_sql(name: str, kind: str) -> str:
    q = quoted(name)
    if kind == "string":
        from colprism.functions.columns import PARSABLE_NUMBER
        pattern = _literal(PARSABLE_NUMBER)
        return f"CASE WHEN trim({q}) RLIKE {pattern} THEN try_cast(trim({q}) AS DOUBLE) END"
    if kind == "boolean":
        return f"CAST(CAST({q} AS INT) AS DOUBLE)"
    return f"nullif(CAST({q} AS DOUBLE), double('NaN'))"


def _date_sql(name: str, kind: str) -> dict[str, str]:
    if kind == "string":
        shapes = ", ".join(
            f"CASE WHEN trim({quoted(name)}) RLIKE {_literal(s)} THEN try_to_timestamp(trim({quoted(name)}), {_literal(p)}) END"
            for s, p in fixed.DATE_FORMATS)
        ts = f"coalesce({shapes})"
    else:
        ts = f"CAST({quoted(name)} AS TIMESTAMP)"
    made = {"year": f"year({ts})", "month": f"month({ts})", "day": f"dayofmonth({ts})",
            "weekday": f"weekday({ts})", "hour": f"hour({ts})", "epoch": f"unix_micros({ts}) / 1e6D"}
    return {p: f"CAST({e} AS DOUBLE)" for p, e in made.items()}


def prepare_features(train: DataFrame, columns: dict[str, list[str]], scale: bool) -> Prepared:
    """Fits median / mode filling, rare-category one-hot, date parts and scaling.

    All numbers come from ``train`` alone. Columns without any value are left out.
    """
    train = nan_to_null(train)
    kinds = physicals(train)
    out = Prepared(columns, scale)
    raw: dict[str, tuple[str, str]] = {}
    for c in columns["numeric"]:
        raw[c] = (c, _number_sql(c, kinds[c]))
    dated: dict[str, tuple[str, str]] = {}
    for c in columns["temporal"]:
        dated.update({f"{c}__{p}": (c, e) for p, e in _date_sql(c, kinds[c]).items()})

    cells = {**raw, **dated}
    numbers = _fitted_numbers(train, cells, scale) if cells else {}

    def add(names):
        for name in names:
            if name in numbers:
                out.names.append(name)
                out.sources.append(cells[name][0])
                out.expressions.append(numbers[name])

    add(raw)
    if columns["categorical"]:
        _add_categories(train, columns["categorical"], out)
    add(dated)
    if not out.expressions:
        raise ValueError("no usable feature columns to train on")
    return out


def _fitted_numbers(train: DataFrame, cells: dict[str, tuple[str, str]], scale: bool) -> dict[str, str]:
    """SQL per number: gaps filled with the median, then scaled if asked."""
    names = {name: f"_{i}" for i, name in enumerate(cells)}
    values = train.select(*[F.expr(e).alias(names[n]) for n, (_, e) in cells.items()])
    medians = {n: q[1] for n, q in quartiles(values, list(names.values())).items() if q[1] is not None}
    moments = {}
    if scale and medians:
        filled = {n: F.coalesce(F.col(n), F.lit(m)) for n, m in medians.items()}
        moments = {r["name"]: (r["mean"], r["std"] or 1.0) for r in number_facts(values, filled).collect()}
    out = {}
    for name, (_, expression) in cells.items():
        n = names[name]
        if n in medians:
            out[name] = f"coalesce({expression}, {float(medians[n])!r}D)"
            if scale:
                out[name] = f"({out[name]} - ({moments[n][0]!r}D)) / {moments[n][1]!r}D"
    return out


def _add_categories(train: DataFrame, columns: list[str], out: Prepared) -> None:
    from colprism.operators.cleaning import mode_values
    modes = mode_values(train, columns)
    filled = train.select(*[
        F.coalesce(col(c).cast("string"), F.lit(modes[c])).alias(c) for c in columns if modes[c] is not None])
    if not filled.columns:
        return
    kept: dict[str, list[str]] = {c: [] for c in filled.columns}
    values: dict[str, int] = dict.fromkeys(filled.columns, 0)
    for r in category_table(filled, filled.columns).orderBy("name", "value").collect():
        values[r["name"]] = r["values"]
        if r["kept"]:
            kept[r["name"]].append(r["value"])
    for c in filled.columns:
        text = f"coalesce(CAST({quoted(c)} AS STRING), {_literal(modes[c])})"
        for v in kept[c]:
            out.names.append(f"{c}_{v}")
            out.sources.append(c)
            out.expressions.append(f"CASE WHEN {text} = {_literal(v)} THEN 1.0D ELSE 0.0D END")
        if len(kept[c]) < values[c] or not kept[c]:
            inside = ", ".join(_literal(v) for v in kept[c]) or "''"
            out.names.append(f"{c}_{RARE}")
            out.sources.append(c)
            out.expressions.append(f"CASE WHEN {text} NOT IN ({inside}) THEN 1.0D ELSE 0.0D END")
