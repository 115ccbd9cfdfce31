"""Validated joins, paging and ordering with explicit ties."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from fieldloom.sources.store import cut


class KeyError1to1(ValueError):
    """A join that should be one to one is not."""


def check_unique(df: DataFrame, key: str, name: str = "table") -> None:
    twice = df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise KeyError1to1(f"{name} holds {key} = {twice[0][0]} more than once")


def one_to_one_left(left: DataFrame, right: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Left join that keeps the left rows as they are in number; null keys match nothing."""
    if check:
        check_unique(left, key, "left")
        check_unique(right, key, "right")
    return left.join(right, key, "left")


def check_contained(keys: DataFrame, within: DataFrame, key: str) -> None:
    if not keys.select(key).join(within.select(key), key, "left_anti").isEmpty():
        raise ValueError(f"keys of {key} are missing")


def lookup(df: DataFrame, table: DataFrame, key: str, max_rows: int = 1_000_000) -> DataFrame:
    """Left join with a table that is broadcast only if it has no more than max_rows rows."""
    small = table.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(table) if small else table, key, "left")


def lookup_in_order(ids: DataFrame, table: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of the table in the order of a list of ids (key, position)."""
    return ids.join(table, key, "left").orderBy(position)


def membership(df: DataFrame, keys: DataFrame, key: str, out: str = "is_member") -> DataFrame:
    return df.join(keys.select(key).distinct().withColumn("__in", F.lit(True)), key, "left").withColumn(out, F.col("__in").isNotNull()).drop("__in")


def inner(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both sides with equal keys; null keys match nothing."""
    return left.join(right, key)


def matched(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def unmatched(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def stack(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def nulls_last(c: str, descending: bool = False) -> Column:
    return F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last()


def page(df: DataFrame, order: Sequence[Column], size: int, number: int) -> tuple[DataFrame, int, int]:
    """Rows of a page (from 1, clamped), the page's number and the number of pages. The order must end with a unique key."""
    pages = max(1, -(-df.count() // size))
    number = min(max(1, number), pages)
    return df.orderBy(*order).offset((number - 1) * size).limit(size), number, pages


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Sort and limit together: each task keeps k rows."""
    return df.orderBy(*order).limit(k)


def facet(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, by the hash of key and seed: the same on every cluster."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """Stored rows in a total order with <column>_before, the sum of each (long) column over all rows before.

    Sorted ranges are summed apart in their tasks; the totals of the ranges, one row each, are the only thing that is
    looked at as a whole. No task holds more than a range.
    """

    def running(batches):
        block, done = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            made = []
            for c in sums:
                own = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(own)
                made.append(pa.array(total - own + done[c], pa.int64()))
                done[c] += int(total[-1]) if len(total) else 0
            yield pa.record_batch([*batch.columns, pa.array(np.full(batch.num_rows, block, np.int32)), *made], names=[*batch.schema.names, "__block", *(f"__{c}" for c in sums)])

    schema = StructType([*df.schema.fields, StructField("__block", IntegerType()), *(StructField(f"__{c}", LongType()) for c in sums)])
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(running, schema), "ranges")
    totals = rows.groupBy("__block").agg(*(F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums)))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("__block", *(F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).cast("long").alias(f"__s{i}") for i in range(len(sums))))
    return rows.join(F.broadcast(shift), "__block").select(*df.columns, *((F.col(f"__{c}") + F.col(f"__s{i}")).alias(f"{c}_before") for i, c in enumerate(sums)))


def numbered(df: DataFrame, order: Sequence[Column], out: str = "position", start: int = 1) -> DataFrame:
    """Consecutive numbers in a total order."""
    return prefix_sums(df.withColumn("__one", F.lit(1).cast("long")), order, ["__one"]).withColumn(out, F.col("__one_before") + start).drop("__one", "__one_before")


def split_by_gaps(df: DataFrame, column: str, gap: float, out: str, keys: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Stored rows of df with a number for each stretch of values of the column, within the keys, that no step over `gap`
    cuts. The columns hold no null.

    Rows are sorted once in ranges, and each is compared with the one before it in its task; how the ranges go on from
    each other is seen from their ends, one row each. ties: columns that part equal rows, so that ranges are of one size."""
    keys = list(keys)

    def marked(batches):
        block, held, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            last = []
            for c in [*keys, column]:
                own = batch.column(c).to_numpy(zero_copy_only=False)
                last.append(own[-1:])
                both = np.concatenate([own[:1] if held is None else held[len(last) - 1], own])
                before, after = both[:-1], both[1:]
                # Equal values, not a number among them, are one; their difference need not be a number.
                apart = (before != after) & ~((before != before) & (after != after))
                if c == column:
                    at = np.flatnonzero(apart)
                    apart[at] = ~(after[at] - before[at] <= np.float64(gap)).astype(bool)
                new |= apart
            count = np.cumsum(new) + done
            held, done = last, int(count[-1])
            yield pa.record_batch([*batch.columns, pa.array(np.full(batch.num_rows, block, np.int32)), pa.array(count, pa.int64())], names=[*batch.schema.names, "__block", "__cuts"])

    order = [F.col(c).asc() for c in (*keys, column, *ties)]
    schema = StructType([*df.schema.fields, StructField("__block", IntegerType()), StructField("__cuts", LongType())])
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(marked, schema), "stretches")
    place = F.struct(*keys, column)
    ends = rows.groupBy("__block").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("__cuts").alias("own"))
    before, after = Window.orderBy("__block"), Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("__last", F.lag("high").over(before))
    cuts = F.col("__last").isNull() | (F.col(f"low.{column}") - F.col(f"__last.{column}") > gap) & (F.col(f"low.{column}") != F.col(f"__last.{column}"))
    for k in keys:
        cuts = cuts | (F.col(f"low.{k}") != F.col(f"__last.{k}"))
    shift = ends.withColumn("__new", cuts.cast("long")).select("__block", (F.sum(F.col("own") + F.col("__new")).over(after) - F.col("own") - 1).alias("__shift"))
    return rows.join(F.broadcast(shift), "__block").select(*df.columns, (F.col("__cuts") + F.col("__shift")).alias(out))


def sequential_ids(df: DataFrame, order: Sequence[Column], prefix: str, width: int, out: str = "id") -> DataFrame:
    return numbered(df, order, "__k").withColumn(out, F.concat(F.lit(prefix), F.lpad(F.col("__k").cast("string"), width, "0"))).drop("__k")
