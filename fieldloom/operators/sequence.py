"""Operations along an ordered line: spacing, missing positions, runs, neighbours, chains."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from fieldloom.operators.aggregates import quantiles
from fieldloom.operators.relational import numbered, split_by_gaps
from fieldloom.sources.store import cut


def _order(line: str | Sequence[str], along: str, tie: str | None = None):
    keys = [line] if isinstance(line, str) else list(line)
    return Window.partitionBy(*keys).orderBy(along, *([tie] if tie else []))


def differences(df: DataFrame, line: str, along: str, tie: str | None = None, out: str = "step") -> DataFrame:
    return df.withColumn(out, F.col(along) - F.lag(along).over(_order(line, along, tie)))


def typical_spacing(df: DataFrame, line: str, along: str, low: float, high: float, default: float) -> DataFrame:
    """Per line: median of the steps inside [low, high], or the default where no step is."""
    steps = differences(df, line, along)
    return steps.groupBy(line).agg(F.coalesce(F.median(F.when(F.col("step").between(low, high), F.col("step"))), F.lit(float(default))).alias("spacing"), F.count("*").alias("n"))


def missing_positions(df: DataFrame, line: str, along: str, spacing: DataFrame, low: float, high: float, tie: str | None = None) -> DataFrame:
    """Evenly placed positions in gaps of low to high times the line's spacing: round(gap / spacing) - 1 of them,
    halves to even. spacing: line, spacing (joined by the line)."""
    after = F.lead(along).over(_order(line, along, tie))
    gaps = df.select(line, F.col(along).alias("__from"), (after - F.col(along)).alias("gap")).join(spacing.select(line, "spacing"), line)
    ratio = F.col("gap") / F.col("spacing")
    n = (F.bround(ratio) - 1).cast("int")
    return gaps.where((ratio >= low) & (ratio <= high)).withColumn("n", n).where("n >= 1").select(line, "gap", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"), "__from").select(line, (F.col("__from") + F.col("gap") * F.col("k") / (F.col("n") + 1)).alias(along), "gap", "n", "k")


def runs(df: DataFrame, line: str, along: str, flag: Column, least: int = 1, tie: str | None = None) -> DataFrame:
    """Maximal runs of rows with the flag, of at least so many: first, last and length."""
    w = _order(line, along, tie)
    place = df.select(line, along, *([tie] if tie else []), flag.alias("__flag")).withColumn("__i", F.row_number().over(w)).where("__flag")
    island = F.col("__i") - F.row_number().over(_order(line, "__i"))
    return place.withColumn("__run", island).groupBy(line, "__run").agg(F.min(along).alias("first"), F.max(along).alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("__run")


def islands(df: DataFrame, line: str, along: str, gap: float, tie: str | None = None, out: str = "group") -> DataFrame:
    """Numbers groups of rows whose steps stay within the gap."""
    w = _order(line, along, tie)
    new = F.when(F.coalesce(F.col(along) - F.lag(along).over(w) > gap, F.lit(True)), 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def seeded_groups(df: DataFrame, line: str, along: str, gap: float, out: str = "group") -> DataFrame:
    """Groups that reach at most `gap` beyond their first row; each line's groups are found in order."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(along, kind="stable")
        seed, group, found = -np.inf, 0, []
        for x in rows[along]:
            if x - seed > gap:
                seed, group = x, group + 1
            found.append(group)
        return rows.assign(**{out: found})

    return df.groupBy(line).applyInPandas(walk, df.withColumn(out, F.lit(1)).schema)


def representatives(df: DataFrame, keys: Sequence[str], best: str, tie: str, take: Sequence[str], largest: Sequence[str] = (), any_of: Sequence[str] = (), mean: Sequence[str] = ()) -> DataFrame:
    """One row for each group: some columns of its best row, maximum, any or mean of others, and the number of parts."""
    order = F.struct(F.col(best), F.col(tie))
    return df.groupBy(*keys).agg(*(F.max_by(c, order).alias(c) for c in (best, *take)), *(F.max(c).alias(c) for c in largest), *(F.bool_or(c).alias(c) for c in any_of), *(F.avg(c).alias(c) for c in mean), F.count("*").alias("n_parts"))


def small_groups(df: DataFrame, key: str, share: float, least_groups: int = 3) -> DataFrame:
    """Groups with their size and whether it is below a share of the median size (never among fewer groups than asked)."""
    counts = cut(df.groupBy(key).agg(F.count("*").alias("n")), "group-sizes")
    middle = quantiles(counts, "n", [0.5]).agg(F.max(F.col("q")[0]).alias("__median"), F.max("n").alias("__groups"))
    return counts.crossJoin(F.broadcast(middle)).select(key, "n", ((F.col("__groups") >= least_groups) & (F.col("n") < share * F.col("__median"))).alias("small"))


def neighbours(df: DataFrame, line: str, along: str, value: str, reach: int, tie: str | None = None) -> DataFrame:
    """Each row with the values of the rows up to so many places before and after it on its line."""
    w = _order(line, along, tie).rowsBetween(-reach, reach)
    return df.withColumn("neighbours", F.collect_list(value).over(w))


def previous_next(df: DataFrame, order: Sequence[str], value: str, partition: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumns({"previous": F.lag(value).over(w), "next": F.lead(value).over(w)})


def ranked_names(df: DataFrame, key: str, value: str, names: Sequence[str]) -> DataFrame:
    """Groups by falling mean of a value, with a name for each rank."""
    means = df.groupBy(key).agg(F.avg(value).alias("mean"))
    rank = F.row_number().over(Window.orderBy(F.desc("mean"), key))
    return means.withColumn("rank", rank).withColumn("name", F.get(F.array(*map(F.lit, names)), F.col("rank") - 1))


def peaks(df: DataFrame, line: str, at: str, value: str, distance: float, prominence: float) -> DataFrame:
    """Local maxima of a profile that stand out by at least `prominence` and keep a distance, the highest first."""

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(at, kind="stable").reset_index(drop=True)
        v, x = rows[value].to_numpy(dtype=float), rows[at].to_numpy(dtype=float)
        top = [i for i in range(1, len(v) - 1) if v[i] > v[i - 1] and v[i] >= v[i + 1]]
        kept: list[int] = []
        for i in sorted(top, key=lambda i: (-v[i], x[i])):
            higher = np.flatnonzero(v > v[i])
            left, right = higher[higher < i], higher[higher > i]
            low = max(v[(left[-1] if len(left) else 0) : i + 1].min(), v[i : (right[0] if len(right) else len(v) - 1) + 1].min())
            if v[i] - low >= prominence and all(abs(x[i] - x[j]) >= distance for j in kept):
                kept.append(i)
        return rows.loc[sorted(kept), [line, at, value]]

    return df.select(line, at, value).groupBy(line).applyInPandas(find, df.select(line, at, value).schema)


def _linked(blocks: list, places: list[float], tolerance: float, max_lag: int) -> list[int]:
    """Numbers of tracks, in the order of their beginnings, of rows sorted by block and position."""
    open_: dict[int, tuple[float, float]] = {}
    track, made, low = [-1] * len(blocks), 0, 0
    while low < len(blocks):
        now, high = blocks[low], low + 1
        while high < len(blocks) and blocks[high] == now:
            high += 1
        open_ = {t: (seen, p) for t, (seen, p) in open_.items() if now - seen <= max_lag}
        held = sorted((p, t) for t, (_, p) in open_.items())
        own = [p for p, _ in held]
        pairs = []
        for i in range(low, high):
            near = range(bisect_left(own, places[i] - tolerance), bisect_right(own, places[i] + tolerance))
            pairs += [(d, held[k][1], i) for k in near if (d := abs(places[i] - own[k])) <= tolerance]
        used: set[int] = set()
        for _, t, i in sorted(pairs):
            if t not in used and track[i] < 0:
                used.add(t)
                track[i] = t
        for i in range(low, high):
            if track[i] < 0:
                track[i] = made
                made += 1
            open_[track[i]] = (now, places[i])
        low = high
    return track


def link_tracks(df: DataFrame, block: str, at: str, tolerance: float, max_lag: int) -> DataFrame:
    """Numbers tracks of positions over successive blocks: a position goes on the nearest open track within tolerance
    that was seen at most max_lag blocks ago, closest pairs first. Tracks are numbered by their first block and position;
    a row without a block or position has none.

    Positions that a step over the tolerance parts from all others never share a track, nor do blocks with more than
    max_lag between them. The table is cut along such steps, by position, by block and by position again; each piece is
    linked by itself, and the result equals that of one walk over all blocks. A piece that no such step cuts is one task.
    """
    rows = cut(df.withColumn("__id", F.monotonically_increasing_id()), "positions")
    known = rows.where(F.col(block).isNotNull() & F.col(at).isNotNull() & ~F.isnan(F.col(at).cast("double")))
    parts = known.select("__id", F.col(block).alias("__when"), F.col(at).alias("__at"))
    parts = split_by_gaps(parts, "__at", tolerance, "__p1", ties=["__when"])
    parts = split_by_gaps(parts, "__when", max_lag, "__p2", ["__p1"], ["__at"])
    parts = split_by_gaps(parts, "__at", tolerance, "__p3", ["__p2"], ["__when"])

    def link(piece: pa.Table) -> pa.Table:
        piece = piece.sort_by([("__when", "ascending"), ("__where", "ascending"), ("__id", "ascending")])
        track = np.array(_linked(piece["__when"].to_pylist(), piece["__where"].to_pylist(), tolerance, max_lag))
        first = np.zeros(len(track), dtype=bool)
        first[np.unique(track, return_index=True)[1]] = True
        return piece.append_column("__local", pa.array(track, pa.int64())).append_column("__first", pa.array(first))

    slim = parts.select("__id", "__when", F.col("__at").cast("double").alias("__where"), F.col("__p3").alias("__piece"))
    found = cut(slim.groupBy("__piece").applyInArrow(link, StructType([*slim.schema.fields, StructField("__local", LongType()), StructField("__first", BooleanType())])), "tracks")
    named = numbered(found.where("__first").drop("__first"), [F.asc("__when"), F.asc("__where"), F.asc("__id")], "track", 0)
    of_row = found.join(named.select("__piece", "__local", "track"), ["__piece", "__local"]).select("__id", "track")
    return rows.drop(*(c for c in ("track",) if c in rows.columns)).join(of_row, "__id", "left").drop("__id")


def chain_select(df: DataFrame, line: str, along: str, score: str, spacing: float, weight: float) -> DataFrame:
    """Of each line the chain of rows with the largest sum of scores less weight times the squared relative deviation of
    its steps from multiples of the spacing. Ties: the earlier predecessor.

    Every earlier row can be the predecessor. They are tried in blocks, the nearest first, until the largest total
    of the rest is under the best value found: a penalty is never negative, so none of the rest can be better."""
    if weight < 0:
        raise ValueError("weight is negative")

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(along, kind="stable").reset_index(drop=True)
        x, s = rows[along].to_numpy(dtype=float), rows[score].to_numpy(dtype=float)
        total, back, top = s.copy(), np.full(len(s), -1), s.copy()
        for i in range(1, len(s)):
            high, size, most = i, 64, 0.0
            # top[k]: largest total up to k. A rest that can only equal the best still counts, for its earlier row.
            while high > 0 and top[high - 1] > 0 and top[high - 1] >= most:
                low = max(0, high - size)
                step = (x[i] - x[low:high]) / spacing
                value = total[low:high] - weight * (step - np.maximum(1, np.round(step))) ** 2
                j = int(np.argmax(value))
                if value[j] > 0 and value[j] >= most:
                    most, back[i] = value[j], low + j
                high, size = low, 2 * size
            total[i] = s[i] + most
            top[i] = max(top[i - 1], total[i])
        i, chosen = int(np.argmax(total)) if len(s) and total.max() > 0 else -1, []
        while i >= 0:
            chosen.append(i)
            i = back[i]
        return rows.loc[chosen[::-1]]

    return df.groupBy(line).applyInPandas(best, df.schema)


def line_distances(knots: DataFrame, line: str, at: str, samples: Sequence[float], x: str, y: str) -> DataFrame:
    """Median distance of each line to the next one, from interpolation at common positions. knots: line, at (array x), y."""
    from fieldloom.functions.geometry import interpolate

    rows = knots.select(line, at, F.explode(F.array(*map(F.lit, samples))).alias("__s"), F.col(x).alias("__x"), F.col(y).alias("__y")).withColumn("__v", interpolate("__x", "__y", "__s"))
    after = F.lead("__v").over(Window.partitionBy("__s").orderBy(at))
    return rows.withColumn("__d", F.abs(after - F.col("__v"))).where("__d IS NOT NULL").groupBy(line).agg(F.median("__d").alias("distance"))
