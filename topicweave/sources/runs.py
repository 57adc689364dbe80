"""Stored runs and workspaces."""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUN = """run_id string, experiment_id string, model_name string, display_name string, config_hash string, config string, seed long,
    status string, error string, corpus_hash string, metrics map<string,double>,
    topics map<string,struct<label: string, keywords: array<string>, size: long>>, assignments array<int>, created_at string"""
MOST_ARTIFACTS = 20_000


class RunStore:
    """Runs as JSON, one folder per experiment; a run saved again replaces the former by its later time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, record: dict) -> None:
        row = {"created_at": time.strftime("%Y-%m-%dT%H:%M:%S")} | record
        self.spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").json(f"{self.root}/experiment={record['experiment_id']}")

    def load(self, experiment: str | None = None) -> DataFrame:
        """The last record of each run, in the order of run ids; lines that cannot be read are left out."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], RUN)
        path = f"{self.root}/experiment={experiment or '*'}"
        rows = self.spark.read.schema(RUN).option("mode", "DROPMALFORMED").json(path).filter("run_id is not null")
        last = W.partitionBy("experiment_id", "run_id").orderBy(F.col("created_at").desc(), F.col("status"))
        return rows.withColumn("r", F.row_number().over(last)).filter("r = 1").drop("r").orderBy("run_id")

    def done(self, experiment: str) -> DataFrame:
        return self.load(experiment).filter("status = 'done'").select("run_id")

    def exists(self, experiment: str, run_id: str) -> bool:
        return not self.done(experiment).filter(F.col("run_id") == run_id).isEmpty()


def pending(grid: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the grid (run_id, ...) without a finished run."""
    return grid.join(runs.filter("status = 'done'").select("run_id"), "run_id", "left_anti")


def for_statistics(runs: DataFrame) -> DataFrame:
    """Stored runs in the form that the statistics take: model by its shown name."""
    return runs.withColumn("model", F.coalesce(F.when(F.col("display_name") != "", F.col("display_name")), "model_name"))


def assignments(runs: DataFrame) -> DataFrame:
    """model, config_hash, seed, doc_idx, topic_id of finished runs that kept them."""
    done = for_statistics(runs).filter("status = 'done' and size(assignments) > 0")
    return done.select("model", "config_hash", "seed", F.posexplode("assignments").alias("doc_idx", "topic_id"))


def experiments(runs: DataFrame) -> DataFrame:
    """experiment_id, n_runs, n_done, models, created_at, latest first."""
    return runs.groupBy("experiment_id").agg(F.count("*").alias("n_runs"), F.count_if(F.col("status") == "done").alias("n_done"), F.array_sort(F.collect_set("model_name")).alias("models"), F.max("created_at").alias("created_at")).orderBy(F.col("created_at").desc(), "experiment_id")


class Workspaces:
    """Snapshots of a result and its report, as JSON lines."""

    SCHEMA = "workspace_id string, name string, saved_at string, payload string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, workspace: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{workspace}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def save(self, name: str, payload: dict) -> str:
        artifacts = {k: v for k, v in payload.get("artifacts", {}).items() if not hasattr(v, "__len__") or len(v) <= MOST_ARTIFACTS}
        workspace = f"{re.sub(r'[^0-9A-Za-z_가-힣-]+', '_', name).strip('_') or 'workspace'}-{time.time_ns()}"
        row = [(workspace, name, time.strftime("%Y-%m-%dT%H:%M:%S"), json.dumps(payload | {"artifacts": artifacts}, ensure_ascii=False, default=plain))]
        self.spark.createDataFrame(row, self.SCHEMA).coalesce(1).write.json(f"{self.root}/{workspace}")
        return workspace

    def list(self) -> DataFrame:
        fs, p = self._path("")
        if not fs.exists(p) or not fs.listStatus(p):
            return self.spark.createDataFrame([], "workspace_id string, name string, saved_at string")
        return self.spark.read.schema(self.SCHEMA).option("mode", "DROPMALFORMED").json(f"{self.root}/*").filter("workspace_id is not null").drop("payload").orderBy(F.col("saved_at").desc(), F.col("workspace_id").desc())

    def load(self, workspace: str) -> dict:
        return json.loads(self.spark.read.schema(self.SCHEMA).json(f"{self.root}/{workspace}").first()["payload"])

    def delete(self, workspace: str) -> bool:
        fs, p = self._path(workspace)
        return fs.delete(p, True)


def plain(value):
    """NumPy numbers and arrays, sets and tuples as JSON has them."""
    if hasattr(value, "tolist"):
        return value.tolist()
    if isinstance(value, (set, tuple)):
        return list(value)
    return str(value)
