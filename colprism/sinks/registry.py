"""Datasets and runs kept as Parquet tables under one shared folder.

Records are appended, never rewritten: the latest record of an id counts.
Forgetting a dataset appends a record that hides it and its runs, then deletes
its rows, its views and the tables of its runs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colprism.operators.schema import suggest_targets
from colprism.plans.training import Training
from colprism.session import remove

PARTS = ("importance", "confusion", "examples", "sizes")
FIELDS = "id string, name string, meta string, created timestamp, forgotten boolean"


class Registry:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _append(self, table: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.folder}/{table}")

    def _records(self) -> DataFrame:
        try:
            found = self.spark.read.schema(FIELDS).parquet(f"{self.folder}/records")
        except AnalysisException:
            return self.spark.createDataFrame([], FIELDS)
        latest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("created"), F.desc("forgotten")))
        return found.withColumn("_at", latest).where("_at = 1").drop("_at")

    def register_dataset(self, df: DataFrame, meta: DataFrame, schema: DataFrame) -> str:
        """Keeps a table with its meta and schema; returns its id."""
        key = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/data/{key}")
        schema.write.parquet(f"{self.folder}/views/{key}/schema")
        described = meta.select(F.to_json(F.struct(*meta.columns)).alias("meta"), "name")
        self._append("records", described.select(
            F.lit(key).alias("id"), "name", "meta", F.current_timestamp().alias("created"), F.lit(False).alias("forgotten")))
        return key

    def list_datasets(self) -> DataFrame:
        """Kept datasets, newest first."""
        return self._records().where("not forgotten").drop("forgotten").orderBy(F.desc("created"))

    def load_dataset(self, key: str) -> DataFrame:
        if self._records().where((F.col("id") == key) & ~F.col("forgotten")).isEmpty():
            raise KeyError("no dataset '%s'" % key)
        return self.spark.read.parquet(f"{self.folder}/data/{key}")

    def describe_dataset(self, key: str) -> dict[str, DataFrame]:
        """Meta, schema and suggested targets of a kept dataset."""
        self.load_dataset(key)
        schema = self.cached_view(key, "schema")
        return {"meta": self.list_datasets().where(F.col("id") == key), "schema": schema,
                "suggested_targets": suggest_targets(schema)}

    def cached_view(self, key: str, view: str, build=None) -> DataFrame:
        """A view built once per dataset and read from then on."""
        path = f"{self.folder}/views/{key}/{view}"
        try:
            return self.spark.read.parquet(path)
        except AnalysisException:
            if build is None:
                raise KeyError("no %s for dataset '%s'" % (view, key)) from None
            build(self.load_dataset(key)).write.parquet(path)
            return self.spark.read.parquet(path)

    def forget_dataset(self, key: str) -> None:
        known = self.list_datasets().where(F.col("id") == key)
        self._append("records", known.select(
            "id", "name", "meta", F.current_timestamp().alias("created"), F.lit(True).alias("forgotten")))
        if self._forgotten(key):
            runs = [r["id"] for r in self._runs().where(F.get_json_object("record", "$.dataset") == key).select("id").collect()]
            for part in (f"data/{key}", f"views/{key}", *(f"run/{run}" for run in runs)):
                remove(self.spark, f"{self.folder}/{part}")

    def _forgotten(self, key: str) -> bool:
        return not self._records().where((F.col("id") == key) & F.col("forgotten")).isEmpty()

    def _runs(self) -> DataFrame:
        try:
            return self.spark.read.schema("id string, record string").parquet(f"{self.folder}/runs")
        except AnalysisException:
            return self.spark.createDataFrame([], "id string, record string")

    def save_run(self, dataset: str, training: Training) -> str:
        """Keeps a finished run readable: its record, leaderboard and child tables."""
        key = uuid.uuid4().hex
        parts = {part: [r.algorithm for r in training.results if getattr(r, part) is not None and getattr(r, part).columns]
                 for part in PARTS}
        for part, algorithms in parts.items():
            for result in training.results:
                if result.algorithm in algorithms:
                    getattr(result, part).write.parquet(f"{self.folder}/run/{key}/{part}/{result.algorithm}")
        training.leaderboard(self.spark).write.parquet(f"{self.folder}/run/{key}/leaderboard")
        # the record comes last: a run whose tables are not whole is not listed
        record = json.dumps({"dataset": dataset, "task": training.task, "target": training.target,
                             "rows_used": training.rows_used, "rows_sampled": training.rows_sampled,
                             "score_name": training.score_name, "best": training.best and training.best.algorithm,
                             "test_size": training.test_size, "parts": parts})
        self._append("runs", self.spark.createDataFrame([(key, record)], "id string, record string"))
        return key

    def load_run(self, key: str) -> dict:
        """The record of a run, its leaderboard, and per part (importance, ...) a table by algorithm."""
        row = self._runs().where(F.col("id") == key).first()
        record = row and json.loads(row["record"])
        if record is None or self._forgotten(record["dataset"]):
            raise KeyError("no run '%s'" % key)
        folder = f"{self.folder}/run/{key}"
        tables = {part: {a: self.spark.read.parquet(f"{folder}/{part}/{a}") for a in algorithms}
                  for part, algorithms in record.pop("parts").items()}
        return record | tables | {"leaderboard": self.spark.read.parquet(f"{folder}/leaderboard")}
