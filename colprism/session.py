"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# small result tables (a row per column, per pair, per class) may be pinned on
# the driver; this is the most rows any of them may have
PIN_ROWS = 100_000


def build(master: str | None = None, shuffle_partitions: int | None = None, app: str = "colprism") -> SparkSession:
    """A session with the settings the operators expect; a cluster's own win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only where nothing is configured (tests, a single machine) does this fall
    back to a fresh temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="colprism-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote, wherever Spark can write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stable(df: DataFrame) -> DataFrame:
    """Write a table once to reliable storage and read it from there on.

    Needed wherever rows carry drawn values: after an executor is lost a
    recomputed row must not draw again.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Writes a table once into the shared folder and reads it from there on.

    For loops: a checkpoint keeps the estimated size of what it was computed
    from, which multiplies with every join; a file has its own.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(df: DataFrame, limit: int = PIN_ROWS) -> DataFrame:
    """Compute a small result table once and keep it as a local relation.

    For tables whose size follows the number of columns, pairs or classes,
    never the number of rows.
    """
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError("table of more than %d rows cannot be pinned" % limit)
    return df.sparkSession.createDataFrame(rows, df.schema)
