"""Global order without a global sort: ranges of the keys, sorted and summed apart, and prefix sums from their totals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import bytewords as bw
from fieldloom.llm.store import cut, widened

#: Rows that a block is sized for, and blocks at least. A row for each block is brought to the driver and sent to tasks:
#: two numbers for half a million rows.
BLOCK_ROWS, LEAST = 500_000, 16


@bw.tidied
def _running(batches: Iterator[pa.RecordBatch], at: list[int]) -> Iterator[pa.RecordBatch]:
    """Sums of the columns over the rows before, within the partition, and the number of these rows."""
    block = TaskContext.get().partitionId()
    done, rows = [0] * len(at), 0
    for batch in batches:
        made = []
        for k, i in enumerate(at):
            own = batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(own)
            made.append(pa.array(sums - own + done[k], pa.int64()))
            done[k] += int(sums[-1]) if len(sums) else 0
        number = pa.array(np.arange(rows, rows + batch.num_rows), pa.int64())
        rows += batch.num_rows
        names = [f"{batch.schema.names[i]}_sum" for i in at]
        yield pa.record_batch([*batch.columns, pa.array(np.full(batch.num_rows, block, np.int32)), *made, number], names=[*batch.schema.names, "block", *names, "row"])


def ordered(rows: DataFrame, keys: Sequence[str], sums: Sequence[str], name: str) -> DataFrame:
    """Stored rows in the order of the keys (nulls first), with `block` and, within it, <sum>_sum and `row`: the sum of
    the column over the rows before, and their number. rows must be a stored table, as its keys are read twice.

    Equal keys fall into one block: give a key that tells rows of a hot one apart.
    """
    blocks = max(LEAST, -(-rows.count() // BLOCK_ROWS))
    order = [F.col(k).asc_nulls_first() for k in keys]
    dealt = rows.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    at = [rows.columns.index(s) for s in sums]
    schema = widened(rows.schema.fields, {"block": "int", **{f"{s}_sum": "long" for s in sums}, "row": "long"})
    return cut(dealt.mapInArrow(lambda it: _running(it, at), schema), name)


def offsets(ordered: DataFrame, *names: str) -> tuple[DataFrame, dict[str, int]]:
    """(block, <name>_before, rows_before): sums over all blocks before; and the sums over all blocks."""
    totals = ordered.groupBy("block").agg(*(F.sum(n).cast("long").alias(n) for n in names), F.count("*").alias("rows")).orderBy("block").toPandas()
    all_names = [*names, "rows"]
    for n in all_names:
        totals[f"{n}_before"] = (totals[n].cumsum() - totals[n]).astype("int64")
    schema = "block int, " + ", ".join(f"{n}_before long" for n in all_names)
    return ordered.sparkSession.createDataFrame(totals[["block", *(f"{n}_before" for n in all_names)]], schema), {n: int(totals[n].sum()) for n in all_names}
