"""What the operators here add to the library's stored tables."""

from __future__ import annotations

import gc
import time

from pyspark.sql import SparkSession
from pyspark.sql.types import StructField, StructType

from fieldloom.sources.store import cut, drop, qualified, shared_dir

__all__ = ["cut", "drop", "qualified", "release", "shared_dir", "widened"]


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    for _ in range(2):  # what the first collection lets go of is found by the second one
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def widened(fields: list[StructField], added: dict[str, str]) -> StructType:
    """A schema of the fields and of new columns, given by name and type."""
    return StructType([*fields, *StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in added.items())).fields]) if added else StructType(list(fields))
