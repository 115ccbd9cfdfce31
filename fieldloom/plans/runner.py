"""Runs named stages one after the other, each stored as Parquet, with from, only and skip."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


@dataclass
class Runner:
    """stages: name and function of (spark, tables made so far)."""

    stages: Sequence[tuple[str, Stage]]
    folder: str
    seconds: dict[str, float] = field(default_factory=dict)

    def chosen(self, start: str | None = None, only: Sequence[str] = (), skip: Sequence[str] = ()) -> list[str]:
        names = [n for n, _ in self.stages]
        for n in (*([start] if start else []), *only, *skip):
            if n not in names:
                raise ValueError(f"no stage {n}")
        names = names[names.index(start) :] if start else names
        return [n for n in names if (not only or n in only) and n not in skip]

    def run(self, spark: SparkSession, start: str | None = None, only: Sequence[str] = (), skip: Sequence[str] = ()) -> dict[str, DataFrame]:
        """Tables by stage; those of stages that are not chosen are read from the folder if they are there."""
        todo, tables = self.chosen(start, only, skip), {}
        for name, stage in self.stages:
            path = f"{self.folder.rstrip('/')}/{name}"
            if name in todo:
                began = time.time()
                stage(spark, tables).write.mode("overwrite").parquet(path)
                self.seconds[name] = time.time() - began
            elif not self._exists(spark, path):
                continue
            tables[name] = spark.read.parquet(path)
        return tables

    @staticmethod
    def _exists(spark: SparkSession, path: str) -> bool:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def queue_status(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"))


def queue_positions(jobs: DataFrame) -> DataFrame:
    """Waiting jobs with their place in the queue, the oldest first."""
    from fieldloom.operators.relational import numbered

    return numbered(jobs.where(F.col("status") == "queued"), [F.col("created"), F.col("id")], "place")


def recover(jobs: DataFrame, reason: str = "interrupted") -> DataFrame:
    """After a restart nothing that waited or ran goes on: such jobs have failed."""
    lost = F.col("status").isin("queued", "running")
    return jobs.withColumns({"error": F.when(lost, F.lit(reason)).otherwise(F.col("error")), "status": F.when(lost, "failed").otherwise(F.col("status"))})


def newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created"), "id")
