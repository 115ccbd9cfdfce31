"""Selections: a kind and a value that compile to a predicate, and the statistics of the rows they choose."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.predicates import All, Predicate, Some, Test
from fieldloom.functions.scalar import safe_ratio


@dataclass(frozen=True)
class Selection:
    kind: str
    value: str | None = None

    @staticmethod
    def parse(raw: str | None) -> Selection | None:
        """'kind:value', split at the first colon; empty or without a kind: no selection."""
        kind, mark, value = (raw or "").partition(":")
        return Selection(kind, value if mark else None) if kind else None

    def encode(self) -> str:
        return self.kind if self.value is None else f"{self.kind}:{self.value}"


@dataclass(frozen=True)
class Kinds:
    """What the kinds of a selection mean for one table: a column to equal the value, or a fixed condition (a predicate,
    or SQL text where only Spark is to read it)."""

    columns: Mapping[str, str] = field(default_factory=dict)
    conditions: Mapping[str, Predicate | str] = field(default_factory=dict)

    def tree(self, s: Selection | None) -> Predicate | str:
        """All rows without a selection; no row for a kind that this table does not know."""
        if s is None:
            return All(())
        if s.kind in self.columns:
            return Some(()) if s.value is None else Test(self.columns[s.kind], "=", s.value)
        return self.conditions.get(s.kind, Some(()))

    def predicate(self, s: Selection | None) -> Column:
        tree = self.tree(s)
        return F.coalesce(F.expr(tree), F.lit(False)) if isinstance(tree, str) else tree.column()

    def expression(self, s: Selection | None) -> dict:
        """The same predicate as a small expression tree for other renderers."""
        tree = self.tree(s)
        return {"op": "sql", "text": tree} if isinstance(tree, str) else tree.document()


def selection_stats(df: DataFrame, chosen: Column, poor: Column, score: str, size: str) -> DataFrame:
    """One row: rows chosen, their share of all, poor ones, means without nulls. A single pass over the table."""
    pick = lambda c: F.when(chosen, c)
    out = df.agg(F.count("*").alias("total"), F.count_if(chosen).alias("n"), F.count_if(chosen & poor).alias("n_poor"), F.avg(pick(F.col(score))).alias("mean_score"), F.avg(pick(F.col(size))).alias("mean_size"))
    return out.select("n", safe_ratio("n", "total").alias("share"), "n_poor", safe_ratio("n_poor", "n").alias("poor_share"), "mean_score", "mean_size")


def class_mix(df: DataFrame, chosen: Column, key: str) -> DataFrame:
    return df.where(chosen).groupBy(key).agg(F.count("*").alias("n"))


def ranked_groups(df: DataFrame, chosen: Column, key: str, k: int) -> DataFrame:
    """Groups by rows chosen, with the share of the group; ties by key."""
    return df.groupBy(key).agg(F.count_if(chosen).alias("n"), F.count("*").alias("total")).where("n > 0").withColumn("share", safe_ratio("n", "total")).orderBy(F.desc("n"), key).limit(k)


def groups_over(tables: Mapping[str, tuple[DataFrame, Kinds]], s: Selection | None, key: str) -> DataFrame:
    """One selection over several tables (objects and the gaps between them, say): for each group with a chosen row in
    any of them n and total, for each table n_<name> and total_<name>, and the share of all. Each table is counted by
    group first, so the tables meet as a row for each group. A null key is a group like any other."""
    out = None
    for name, (df, kinds) in tables.items():
        chosen = kinds.predicate(s)
        counted = df.groupBy(F.col(key)).agg(F.count_if(chosen).alias("n"), F.count("*").alias("total"))
        both = [(F.col(w) if n == name else F.lit(0).cast("long")).alias(f"{w}_{n}") for n in tables for w in ("n", "total")]
        part = counted.select(key, "n", "total", *both)
        out = part if out is None else out.unionByName(part)
    sums = ["n", "total", *(f"{w}_{n}" for n in tables for w in ("n", "total"))]
    found = out.groupBy(key).agg(*(F.sum(c).alias(c) for c in sums)).where("n > 0")
    return found.withColumn("share", safe_ratio("n", "total"))


def ranked_over(tables: Mapping[str, tuple[DataFrame, Kinds]], s: Selection | None, key: str, k: int) -> DataFrame:
    """The first k groups by rows chosen over all tables; ties by key."""
    return groups_over(tables, s, key).orderBy(F.desc("n"), F.asc_nulls_last(key)).limit(k)
