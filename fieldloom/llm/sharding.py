"""Sharding by bytes: contiguous shards whose sizes are cut at equal targets of a global prefix sum.

Rows are ordered by id (nulls first, then checksum and length of the text, then a number dealt to the rows, so that a
hot or missing id is split as well). Ranges of this order are summed apart; the totals of the ranges, a bounded number
of rows, give each range its place in the global sum, so that no task sees more than a range and texts are never moved:
only (id, size, checksum) is. A row belongs to the shard in whose target its first byte lies, so the bytes of a shard
miss the target by less than one row at either end.

Defined cases: a null or empty text has no bytes; every row counts one byte more than its text, very long ones too;
repeated rows, and rows without an id, get slots of their own; an empty table gives no rows; fewer rows than shards
leave shards empty; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import ranges
from fieldloom.llm.store import cut, drop


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, position): slot counts within the shard, position over all rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    apart = F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("int")
    slim = cut(docs.select(F.col(id_col).alias("__id"), F.col(id_col).cast("long").alias("__key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), apart.alias("__apart")), "sizes")
    rows = ranges.ordered(slim, ["__key", "text_crc32", "size", "__apart"], ["size"], "ordered")
    drop(slim)
    before, sums = ranges.offsets(rows, "size")
    start = F.col("size_sum") + F.col("size_before")
    placed = rows.join(F.broadcast(before), "block").withColumns({"__start": start, "position": F.col("rows_before") + F.col("row")}).withColumn("shard", F.expr(f"CAST(__start * {shards} DIV {sums['size'] or 1} AS INT)"))
    first = placed.groupBy("shard").agg(F.min("position").alias("__first"))
    return placed.join(F.broadcast(first), "shard").select(F.col("__id").alias(id_col), "size", "text_crc32", "shard", (F.col("position") - F.col("__first")).alias("slot"), "position")
