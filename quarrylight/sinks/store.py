"""Workspaces and their analyses as Parquet snapshots.

A change writes a new snapshot folder and then points to it, so readers never
see half a change. Analyses are partitioned by workspace_id: reading one
workspace prunes the others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORKSPACES = "id string, name string, created_at timestamp, updated_at timestamp"
ANALYSES = "id string, file_name string, code string, analyzed_at timestamp, summary map<string,long>, total_findings long, workspace_id string"


def save_settings(path: str, rules: dict[str, bool], entropy_threshold: float) -> None:
    import json

    with open(path, "w") as f:
        json.dump({"rules": rules, "entropyThreshold": entropy_threshold}, f)


def load_settings(path: str) -> tuple[dict[str, bool], float]:
    """Switches of rules and the entropy threshold; a threshold of 0 stays 0, a missing one is 4.5."""
    import json
    import os

    if not os.path.exists(path):
        return {}, 4.5
    with open(path) as f:
        s = json.load(f)
    t = s.get("entropyThreshold")
    return s.get("rules", {}), 4.5 if t is None else float(t)


def without_workspace(workspaces: DataFrame, analyses: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the workspaces in ids(id), and without their analyses: two anti-joins."""
    return workspaces.join(ids, "id", "left_anti"), analyses.join(ids.withColumnRenamed("id", "workspace_id"), "workspace_id", "left_anti")


def listing(workspaces: DataFrame, analyses: DataFrame) -> DataFrame:
    """Workspaces with their number of analyses, latest change first."""
    n = analyses.groupBy(F.col("workspace_id").alias("id")).agg(F.count("*").alias("n_analyses"))
    return workspaces.join(n, "id", "left").withColumn("n_analyses", F.coalesce("n_analyses", F.lit(0))).orderBy(F.desc("updated_at"), "id")


class Store:
    """Workspaces below a folder that Spark can read and write."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _current(self, table: str) -> str | None:
        """The newest complete snapshot: names ascend, and Spark marks complete folders."""
        fs, folder = self._fs(), self._at(table)
        if not fs.exists(folder):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        return next((n for n in reversed(names) if fs.exists(self._at(table, n, "_SUCCESS"))), None)

    def _read(self, table: str, schema: str) -> DataFrame:
        name = self._current(table)
        return self.spark.createDataFrame([], schema) if name is None else self.spark.read.schema(schema).parquet(f"{self.path}/{table}/{name}")

    def _write(self, table: str, df: DataFrame, *by: str) -> None:
        last = self._current(table)
        name = f"{int(last.split('-')[0]) + 1 if last else 0:012d}-{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(f"{self.path}/{table}/{name}") if by else df.write.parquet(f"{self.path}/{table}/{name}")
        if last:
            self._fs().delete(self._at(table, last), True)

    def workspaces(self) -> DataFrame:
        return self._read("workspaces", WORKSPACES)

    def analyses(self, workspace_id: str | None = None) -> DataFrame:
        """Latest first; with workspace_id only that partition is read."""
        a = self._read("analyses", ANALYSES)
        return (a.filter(F.col("workspace_id") == workspace_id) if workspace_id else a).orderBy(F.desc("analyzed_at"), "id")

    def get_analysis(self, id_: str) -> DataFrame:
        return self._read("analyses", ANALYSES).filter(F.col("id") == id_)

    def create(self, name: str) -> str:
        id_ = uuid.uuid4().hex
        row = self.spark.range(1).select(F.lit(id_).alias("id"), F.lit(name).alias("name"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))
        self._write("workspaces", self.workspaces().unionByName(row))
        return id_

    def rename(self, id_: str, name: str) -> None:
        hit = F.col("id") == id_
        w = self.workspaces().withColumn("name", F.when(hit, name).otherwise(F.col("name")))
        self._write("workspaces", w.withColumn("updated_at", F.when(hit, F.current_timestamp()).otherwise(F.col("updated_at"))))

    def delete(self, id_: str) -> None:
        """The workspace and all its analyses."""
        gone = self.spark.createDataFrame([(id_,)], "id string")
        w, a = without_workspace(self.workspaces(), self._read("analyses", ANALYSES), gone)
        self._write("analyses", a, "workspace_id")
        self._write("workspaces", w)

    def save_analysis(self, workspace_id: str, file_name: str, code: str, findings: DataFrame) -> str:
        """Store an analysis with its counts by category and touch the workspace."""
        id_ = uuid.uuid4().hex
        counts = findings.groupBy("category").agg(F.count("*").alias("n"))
        row = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("summary"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_findings"))
        row = row.select(F.lit(id_).alias("id"), F.lit(file_name).alias("file_name"), F.lit(code).alias("code"), F.current_timestamp().alias("analyzed_at"), "summary", "total_findings", F.lit(workspace_id).alias("workspace_id"))
        self._write("analyses", self._read("analyses", ANALYSES).unionByName(row), "workspace_id")
        hit = F.col("id") == workspace_id
        self._write("workspaces", self.workspaces().withColumn("updated_at", F.when(hit, F.current_timestamp()).otherwise(F.col("updated_at"))))
        return id_

    def rename_analysis(self, id_: str, file_name: str) -> None:
        a = self._read("analyses", ANALYSES)
        self._write("analyses", a.withColumn("file_name", F.when(F.col("id") == id_, file_name).otherwise(F.col("file_name"))), "workspace_id")

    def delete_analysis(self, id_: str) -> None:
        self._write("analyses", self._read("analyses", ANALYSES).filter(F.col("id") != id_), "workspace_id")
