"""Connected components of a stored list of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.store import cut, drop


def _least(pairs: DataFrame) -> DataFrame:
    """For each node u of (u, v): the smallest of it and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))


def _large(links: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on the smallest node that it sees."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return both.join(_least(both), "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")


def _small(links: DataFrame) -> DataFrame:
    """Each node hangs itself and its smaller neighbours on the smallest one. links: a < b."""
    down = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    low = _least(down)
    return down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have a link, component being their smallest node. links: a, b (long).

    Each round is written to the shared folder; the pairs of a round are no more than the links. Rounds grow with the
    logarithm of a component's diameter.
    """
    state = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        large = cut(_large(state).distinct(), "large")
        drop(state)
        state = cut(_small(large).distinct(), "small")
        drop(large)
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return state.select(F.col("b").alias("node"), F.col("a").alias("component")).union(state.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        before = mark
