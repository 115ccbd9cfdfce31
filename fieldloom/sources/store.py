"""Materialised tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of sessions that run in one process and name none.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of its own only where that is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="fieldloom-"))
        found = _OWN[0]
    return found.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark resolves it: without one it lies in the default file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def cut(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._fieldloom_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Delete tables made by cut() that no later plan reads."""
    for table in tables:
        path = getattr(table, "_fieldloom_path", None)
        if path:
            jvm = table.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            conf = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
            where.getFileSystem(conf).delete(where, True)
