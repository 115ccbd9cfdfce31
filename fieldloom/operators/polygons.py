"""Joins and measures of simple polygons, given as rings: array<struct<x: double, y: double>>.

Candidates come from the grid cells of their boxes; each pair is made in one cell only and judged exactly in numpy
inside the task, many pairs together. Where areas are wanted the rings of a cell are sent to a task once and meet there;
other pairs come from an equi-join on the cells. A ring closes by itself; a null, fewer than three points, or a
point that is null, infinite or not a number makes it no polygon: it joins with nothing and covers nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import geometry
from fieldloom.operators import overlay
from fieldloom.operators.aggregates import quantiles
from fieldloom.operators.spatial import TASK_PAIRS, cell, cell_join, cell_pairs, spread_tasks
from fieldloom.sources.store import cut

RING = "array<struct<x: double, y: double>>"


# One pair, exactly


def points(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], dtype=float).reshape(-1, 2)


def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area of the intersection of two rings."""
    return float(overlay.overlap_areas(overlay.Rings.one(a), overlay.Rings.one(b))[0])


def meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two polygons have a point in common, edges included."""
    return bool(overlay.meeting(overlay.Rings.one(a), overlay.Rings.one(b))[0])


def simplify(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: the points of an open line that keep every other one within the tolerance."""
    keep, open_ = np.zeros(len(line), dtype=bool), [(0, len(line) - 1)]
    keep[[0, -1]] = True
    while open_:
        i, j = open_.pop()
        if j <= i + 1:
            continue
        d = line[j] - line[i]
        size = float(np.hypot(*d))
        rest = line[i + 1 : j] - line[i]
        far = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / size if size else np.hypot(rest[:, 0], rest[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            open_ += [(i, i + 1 + k), (i + 1 + k, j)]
    return line[keep]


def simplify_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A ring in two lines, between its first point and the one farthest from it; a ring that would collapse stays."""
    if len(ring) < 4:
        return ring
    far = int(np.hypot(*(ring - ring[0]).T).argmax())
    out = np.concatenate([simplify(ring[: far + 1], tolerance)[:-1], simplify(np.concatenate([ring[far:], ring[:1]]), tolerance)[:-1]])
    return out if len(out) > 2 else ring


def outline(pixels: set[tuple[int, int]]) -> list[np.ndarray]:
    """Rings around pixels (row, col), corners as (col, row): outer ones have a positive signed area, holes a negative
    one. Pixels that meet at a corner only are kept apart."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in pixels:
        for other, p, q in (((r - 1, c), (c, r), (c + 1, r)), ((r, c + 1), (c + 1, r), (c + 1, r + 1)), ((r + 1, c), (c + 1, r + 1), (c, r + 1)), ((r, c - 1), (c, r + 1), (c, r))):
            if other not in pixels:
                after.setdefault(p, []).append(q)
    rings = []
    while after:
        start = min(after)
        at, came, own = start, None, []
        while True:
            ways = after[at]
            # At a corner where two pixels touch, turn towards the pixel that one came along.
            turn = lambda q: (came[0] - at[0]) * (q[1] - at[1]) - (came[1] - at[1]) * (q[0] - at[0]) if came else 0  # noqa: B023, E731
            q = min(ways, key=turn)
            ways.remove(q)
            if not ways:
                del after[at]
            if came is None or (at[0] - came[0]) * (q[1] - at[1]) != (at[1] - came[1]) * (q[0] - at[0]):
                own.append(at)
            came, at = at, q
            if at == start:
                break
        rings.append(np.array(own, dtype=float))
    return rings


def signed_area(ring: np.ndarray) -> float:
    b = np.roll(ring, -1, axis=0)
    return float((ring[:, 0] * b[:, 1] - b[:, 0] * ring[:, 1]).sum() / 2)


# Tables


def real(ring: Column | str) -> Column:
    """Whether a ring is a polygon: three points or more, all of them finite."""
    finite = lambda v: v.isNotNull() & (F.abs(v) < float("inf"))
    return F.coalesce((F.size(ring) >= 3) & F.forall(ring, lambda p: F.coalesce(p.isNotNull() & finite(p["x"]) & finite(p["y"]), F.lit(False))), F.lit(False))


def _extent(ring: str, prefix: str = "") -> list[Column]:
    side = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return [side(f, k).alias(f"{prefix}{k}{i}") for k in "xy" for i, f in ((0, F.array_min), (1, F.array_max))]


def _boxes(df: DataFrame, key: str, ring: str, prefix: str, size: float) -> DataFrame:
    known = df.where(real(ring)).select(F.col(key).alias(f"{prefix}k"), F.col(ring).alias(f"{prefix}ring"), *_extent(ring, prefix))
    # Cells of a level are twice as wide as those of the level below: a box goes to the level of its own size.
    width = F.greatest(F.col(f"{prefix}x1") - F.col(f"{prefix}x0"), F.col(f"{prefix}y1") - F.col(f"{prefix}y0"))
    return known.withColumn(f"{prefix}level", F.greatest(F.ceil(F.log2(F.greatest(width / size, F.lit(1.0)))), F.lit(0)).cast("int"))


def _stored_boxes(df: DataFrame, key: str, ring: str, prefix: str, size: float) -> DataFrame:
    """The same, measured once and spread over all tasks however small the file was."""
    rows = cut(df.select(key, ring).repartition(spread_tasks(df)), "rings")
    return cut(_boxes(rows, key, ring, prefix, size).withColumn(f"{prefix}id", F.monotonically_increasing_id()), "boxes")


def _at_levels(df: DataFrame, prefix: str, levels: list[int], size: float) -> DataFrame:
    """Each box in the cells of its own level, four at most, and of the coarser ones among the levels."""
    wide = df.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda v: v >= F.col(f"{prefix}level"))))
    step = F.lit(size) * F.pow(F.lit(2.0), F.col("level"))
    span = lambda k: F.sequence(F.floor(F.col(f"{prefix}{k}0") / step), F.floor(F.col(f"{prefix}{k}1") / step))
    return wide.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))


def _pairs(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes that meet, each made once: at the coarser one of their two levels, in the cell of the lower corner
    of their common part. However large a box, it lies in four cells of a level, and of levels there are some sixty."""
    left, right = _placed(a, b, size)
    low = {k: F.greatest(f"a{k}0", f"b{k}0") for k in "xy"}
    step = F.lit(size) * F.pow(F.lit(2.0), F.col("level"))
    own = F.col("level") == F.greatest("alevel", "blevel")
    meets = (F.least("ax1", "bx1") >= low["x"]) & (F.least("ay1", "by1") >= low["y"])
    here = (F.col("cx") == F.floor(low["x"] / step)) & (F.col("cy") == F.floor(low["y"] / step))
    return cell_join(left, right, ["level", "cx", "cy"]).where(own & meets & here).select("ak", "bk", "aring", "bring")


def _placed(a: DataFrame, b: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    levels = sorted({r[0] for df, k in ((a, "alevel"), (b, "blevel")) for r in df.select(k).distinct().collect()})
    return _at_levels(a, "a", levels, size), _at_levels(b, "b", levels, size)


#: Rings of a cell that meet at once if all are rectangles, the points of such a block, and how many pairs of rectangles
#: take the time of one that is swept.
BLOCK_RINGS, BLOCK_POINTS, SWEEP = 16_384, 131_072, 64
#: A group of rings that meet: all with all of the other side, or (side 2) among themselves.
GROUP = ("part", "level", "cx", "cy", "i", "j")


def _held(df: DataFrame, levels: list[int], size: float) -> DataFrame:
    """Stored boxes in their cells. own: whether that is their level, and not that of coarser boxes; begins: whether their
    lowest x (1) and y (2) lies in the cell."""
    step = F.lit(size) * F.pow(F.lit(2.0), F.col("level"))
    begins = lambda k: (F.col(f"c{k}") == F.floor(F.col(f"a{k}0") / step)).cast("int")
    corner = lambda p: reduce(Column.__and__, ((p[k] == F.col(f"a{k}0")) | (p[k] == F.col(f"a{k}1")) for k in "xy"))
    odd = ~F.size("aring").between(4, 5) | ~F.forall("aring", corner)
    placed = _at_levels(df.where("ax1 > ax0 AND ay1 > ay0").withColumn("odd", odd), "a", levels, size)
    return placed.select(F.col("ak").alias("k"), F.col("aring").alias("ring"), "odd", "aid", *(F.col(f"a{k}").alias(k) for k in ("x0", "y0", "x1", "y1")), "level", "cx", "cy", (F.col("alevel") == F.col("level")).alias("own"), (begins("x") + 2 * begins("y")).alias("begins"))


def _cells_held(held: dict[str, DataFrame]) -> DataFrame:
    """Cells with the rings of their level (name_own_n) and finer ones (name_fine_n) of each table, the number of blocks of
    each (name_own, name_fine), and what a pair costs there: `weight`, 1 for two rectangles."""
    kinds = [(name, kind) for name in held for kind in ("own", "fine")]

    def counted(name: str) -> DataFrame:
        found = []
        for kind, mine in (("own", F.col("own")), ("fine", ~F.col("own"))):
            points = F.sum(F.when(mine, F.size("ring")).otherwise(0))
            found += [c.alias(f"{name}_{kind}_{as_}") for as_, c in (("n", F.count_if(mine)), ("odd", F.count_if(mine & F.col("odd"))), ("points", points))]
        return held[name].groupBy("level", "cx", "cy").agg(*found)

    cells = reduce(lambda p, q: p.join(q, ["level", "cx", "cy"]), map(counted, held))
    plain = 1 - F.greatest(F.lit(0.0), *(F.col(f"{n}_{k}_odd") / F.greatest(f"{n}_{k}_n", F.lit(1)) for n, k in kinds))
    cells = cells.withColumn("weight", 1 + SWEEP * (1 - plain * plain))
    blocks = lambda c: F.ceil(F.greatest(F.col(f"{c}_n") * F.sqrt("weight") / BLOCK_RINGS, F.col(f"{c}_points") / BLOCK_POINTS)).cast("int")
    return cells.withColumns({f"{n}_{k}": blocks(f"{n}_{k}") for n, k in kinds})


def _grouped(a: DataFrame, b: DataFrame | None, size: float, order: Sequence[str]) -> DataFrame:
    """Boxes in the groups in which they meet, a group's rows together: (GROUP, side, k, o_k, ring, box, begins), k of a
    and o_k of b; without b of one table, and k of both sides. order: by which the rows of a group are ranked (rank).

    At a cell of each level the boxes of that level meet each other (part 0) and the finer ones (part 1: own of a, part 2:
    own of b). A cell with many rings or points is dealt in blocks that meet one by one; tasks get about TASK_PAIRS pairs, swept ones
    counted by SWEEP."""
    tables = {"a": a} if b is None else {"a": a, "b": b}
    levels = sorted({r[0] for df in tables.values() for r in df.select("alevel").distinct().collect()}) or [0]
    held = {name: _held(df, levels, size) for name, df in tables.items()}
    cells = _cells_held(held)
    meet = [("a_own", "a_own"), ("a_own", "a_fine")] if b is None else [("a_own", "b_own"), ("a_own", "b_fine"), ("a_fine", "b_own")]
    product = lambda end: reduce(Column.__add__, (F.col(p + end).cast("double") * F.col(q + end) for p, q in meet))
    counts = [f"{name}_{kind}" for name in held for kind in ("own", "fine")]
    pairs, groups, most = cells.agg(F.sum(product("_n") * F.col("weight")), F.sum(product("")), F.max(F.greatest(F.lit(0), *counts))).first()
    full = F.broadcast(cut(cells.where(F.greatest(F.lit(0), *counts) > 1).select("level", "cx", "cy", *counts), "full-cells")) if (most or 0) > 1 else None

    def dealt(name: str) -> DataFrame:
        df = held[name]
        df = df.join(full, ["level", "cx", "cy"], "left") if full is not None else df
        n = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1)) if full is not None else F.lit(1)
        mine = lambda kind: F.pmod(F.xxhash64("aid"), n(f"{name}_{kind}")).cast("int")
        entry = lambda part, i, j, side: F.struct(F.lit(part).alias("part"), i.alias("i"), j.alias("j"), side.alias("side"))

        def against(part: int, kind: str, others: str) -> Column:
            """My block with each of the other side's."""
            block, to = mine(kind), F.sequence(F.lit(0), n(others) - 1)
            first = name == "a" and not (b is None and kind == "fine")
            return F.transform(to, lambda z: entry(part, block, z, F.lit(0)) if first else entry(part, z, block, F.lit(1)))

        if b is None:
            block = mine("own")
            among = F.transform(F.sequence(F.lit(0), n("a_own") - 1), lambda z: entry(0, F.least(z, block), F.greatest(z, block), F.when(z == block, 2).when(z < block, 1).otherwise(0)))
            own, fine = [among, against(1, "own", "a_fine")], against(1, "fine", "a_own")
        else:
            other, mixed = ("b", 1) if name == "a" else ("a", 2)
            own, fine = [against(0, "own", f"{other}_own"), against(mixed, "own", f"{other}_fine")], against(3 - mixed, "fine", f"{other}_own")
        ways = F.when(~F.col("own"), fine).when(F.col("level") > levels[0], F.concat(*own)).otherwise(own[0])
        return df.withColumn("way", F.explode(ways)).select("way.part", "level", "cx", "cy", "way.i", "way.j", "way.side", *keys(name), "ring", "x0", "y0", "x1", "y1", "begins")

    def keys(name: str) -> list[Column]:
        if b is None or order:
            return [F.col("k")]
        kinds = [df.schema["ak"].dataType for df in (a, b)]
        return [(F.col("k") if name == mine else F.lit(None).cast(kind)).alias(as_) for mine, kind, as_ in zip("ab", kinds, ("k", "o_k"), strict=True)]

    rows = reduce(DataFrame.unionByName, map(dealt, held))
    tasks = max(spread_tasks(a), min(int(groups or 0), -(-int(pairs or 0) // TASK_PAIRS)))
    rows = rows.repartition(tasks, *GROUP)
    return rows.withColumn("rank", F.dense_rank().over(Window.partitionBy(*GROUP).orderBy(*order))) if order else rows.sortWithinPartitions(*GROUP)


def _measures(batches: Iterator[pa.RecordBatch], share: bool, ordered: bool) -> Iterator[pa.RecordBatch]:
    """Rows of _grouped. k, o_k and the area of the overlap with both rings' own, or (share) its share of the smaller one;
    ranked rows make no pair of equal keys; ordered: k < o_k. Rectangles along the axes are measured by their sides and
    others by the sweep."""
    for table, cell in overlay.whole_groups(batches, GROUP, overlay.BOXES_AT_ONCE):
        rings = overlay.Rings.of(table.column("ring"))
        column = lambda k: table.column(k).to_numpy()  # noqa: B023, E731
        box = [column(k) for k in ("x0", "y0", "x1", "y1")]
        upright, side = rings.upright(), column("side")
        area = np.where(upright, (box[2] - box[0]) * (box[3] - box[1]), rings.areas())
        plain, ranked = bool(upright.all()), "rank" in table.column_names
        rank = column("rank") if ranked else None
        keys = [table.column(k if k in table.column_names else "k").combine_chunks() for k in ("k", "o_k")]
        left, right, among = (overlay.Placed.of(np.flatnonzero(side == s), cell, *box, column("begins").astype(np.uint8)) for s in (0, 1, 2))
        for i, j, width, height in chain(left.pairs(right), among.pairs()):
            both = width * height
            if not plain:
                odd = np.flatnonzero(~(upright[i] & upright[j]))
                both[odd] = overlay.overlap_areas_of(rings, i[odd], j[odd])
            ok = both > 0
            if ranked:
                p, q = rank[i], rank[j]
                ok &= p != q
                if ordered:
                    i, j = np.where(p < q, i, j), np.where(p < q, j, i)
            if not ok.all():
                i, j, both = i[ok], j[ok], both[ok]
            out = {"ratio": both / np.minimum(area[i], area[j])} if share else {"both": both, "area": area[i], "o_area": area[j]}
            yield pa.record_batch([keys[0].take(pa.array(i)), keys[1].take(pa.array(j)), *map(pa.array, out.values())], names=["k", "o_k", *out])


def polygon_overlays(a: DataFrame, b: DataFrame, a_key: str, b_key: str, ring: str, size: float) -> DataFrame:
    """(k, o_k, both, either, only, o_only): of each pair of polygons of a and b that overlap the areas of intersection,
    union, and both differences. size: of the smallest cells, about that of a small polygon."""
    kinds = [df.schema[k].dataType.simpleString() for df, k in ((a, a_key), (b, b_key))]
    rows = _grouped(_stored_boxes(a, a_key, ring, "a", size), _stored_boxes(b, b_key, ring, "a", size), size, [])
    found = rows.mapInArrow(lambda it: _measures(it, False, False), f"k {kinds[0]}, o_k {kinds[1]}, both double, area double, o_area double")
    return found.select("k", "o_k", "both", (F.col("area") + F.col("o_area") - F.col("both")).alias("either"), (F.col("area") - F.col("both")).alias("only"), (F.col("o_area") - F.col("both")).alias("o_only"))


def polygon_overlaps(df: DataFrame, key: str, ring: str, size: float, other: DataFrame | None = None) -> DataFrame:
    """(k, o_k, ratio): pairs of polygons that overlap and the overlap's share of the smaller one. size: of the smallest
    cells, about that of a small polygon. Of one table each pair once, k < o_k; with another table k is of df, o_k of the
    other, and equal keys make no pair."""
    kind, one = df.schema[key].dataType.simpleString(), other is None
    mine, *theirs = (_stored_boxes(t.where(F.col(key).isNotNull()), key, ring, "a", size) for t in ((df,) if one else (df, other)))
    rows = _grouped(mine, None if one else theirs[0], size, ["k"])
    return rows.mapInArrow(lambda it: _measures(it, True, one), f"k {kind}, o_k {kind}, ratio double")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = overlay.meeting(overlay.Rings.of(batch.column(2)), overlay.Rings.of(batch.column(3)))
        yield batch.select([0, 1]).filter(pa.array(ok))


def polygons_meeting(a: DataFrame, b: DataFrame, a_key: str, b_key: str, ring: str, size: float) -> DataFrame:
    """Pairs of keys of polygons of a and b that have a point in common."""
    found = _met(_stored_boxes(a, a_key, ring, "a", size), _stored_boxes(b, b_key, ring, "b", size), size)
    return found.select(F.col("ak").alias(a_key), F.col("bk").alias(b_key))


def _met(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    kinds = [df.schema[k].dataType.simpleString() for df, k in ((a, "ak"), (b, "bk"))]
    return _pairs(a, b, size).mapInArrow(_meetings, f"ak {kinds[0]}, bk {kinds[1]}")


#: Rings that a cell is swept with at once; cells with more are cut in four, again and again, DEPTH times at most.
CELL_RINGS, DEPTH = 512, 12


def _cells(cx: pa.Array, cy: pa.Array, step: float) -> overlay.Rings:
    """The outlines of cells."""
    x, y = (c.to_numpy(zero_copy_only=False).astype(float) * step for c in (cx, cy))
    return overlay.Rings(np.stack([x, x + step, x + step, x], axis=1).reshape(-1), np.stack([y, y, y + step, y + step], axis=1).reshape(-1), np.arange(len(x) + 1) * 4)


def _covering(batches: Iterator[pa.RecordBatch], step: float) -> Iterator[pa.RecordBatch]:
    """Last columns: ring, cx, cy. Without the cells that a ring only passes by; `whole`: it covers all of the cell."""
    for batch in batches:
        ring, cx, cy = (batch.column(batch.schema.get_field_index(n)) for n in ("ring", "cx", "cy"))
        both = overlay.overlap_areas(overlay.Rings.of(ring), _cells(cx, cy, step))
        out = batch.append_column("whole", pa.array(both >= step * step * (1 - 1e-12)))
        yield out.filter(pa.array(both > 0))


def _cell_unions(names: Sequence[str], step: float) -> Callable[[tuple, pa.Table], pa.Table]:
    def swept(key: tuple, table: pa.Table) -> pa.Table:
        cx, cy = key[-2].as_py() * step, key[-1].as_py() * step
        box = tuple(np.array([v]) for v in (cx, cy, cx + step, cy + step))
        area = overlay.union_areas(np.zeros(len(table), dtype=np.int64), overlay.Rings.of(table.column("ring")), box)
        return pa.table({**{n: table.column(n).slice(0, 1) for n in names}, "area": pa.array(area)})

    return swept


def union_area(df: DataFrame, ring: str, size: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, area): the area that the polygons of each group cover together, what several cover counted once. The plane is
    cut into cells of this size and each is swept by itself. Equal rings fall together before; a cell that some ring
    covers needs no sweep, however many others lie there; a cell with more than CELL_RINGS outlines is cut in four. A ring
    goes to every cell that its box meets. Without keys there is one row, also of no polygons."""
    keys, step, parts = list(keys), float(size), []
    known = df.where(real(ring)).select(*keys, F.col(ring).alias("ring"), *_extent(ring)).distinct()
    span = lambda k: F.sequence(cell(f"{k}0", step), cell(f"{k}1", step))
    placed = known.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y"))).select(*keys, "ring", "cx", "cy")
    names = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    for depth in range(DEPTH + 1):
        rows = cut(placed.mapInArrow(lambda it, step=step: _covering(it, step), ", ".join([*names, f"ring {RING}", "cx long", "cy long", "whole boolean"])), "cells")
        state = rows.groupBy(*keys, "cx", "cy").agg(F.bool_or("whole").alias("w"), F.count("*").alias("n"))
        parts.append(state.where("w").select(*keys, F.lit(step * step).alias("area")))
        open_ = state.where("NOT w").select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), "n")
        mine = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*keys, "cx", "cy")]
        some = open_ if depth == DEPTH else open_.where(F.col("n") <= CELL_RINGS)
        swept = rows.join(some, mine, "left_semi").select(*keys, "ring", "cx", "cy").groupBy(*keys, "cx", "cy").applyInArrow(_cell_unions(keys, step), ", ".join([*names, "area double"]))
        parts.append(cut(swept, "unions"))
        many = open_.where(F.col("n") > CELL_RINGS)
        if depth == DEPTH or many.isEmpty():
            break
        half = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(c)
        placed = rows.join(many, mine, "left_semi").select(*keys, "ring", half("cx"), "cy").select(*keys, "ring", "cx", half("cy"))
        step /= 2
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"))


def _segment_cells(zones: DataFrame, zone: str, ring: str, size: float, reach: float) -> DataFrame:
    """Edges of the rings (zone, ax, ay, bx, by) in the cells (cx, cy) that hold any point within the reach of them: column
    by column of cells only the part of the edge that is near, so a long slanted edge does not fill its box."""
    r = F.col(ring)
    after = F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1))
    edge = F.explode(F.arrays_zip(r.alias("p"), after.alias("q"))).alias("e")
    edges = zones.where(real(ring)).select(F.col(zone).alias("__zone"), edge).select("__zone", F.col("e.p.x").alias("ax"), F.col("e.p.y").alias("ay"), F.col("e.q.x").alias("bx"), F.col("e.q.y").alias("by"))
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    by_column = edges.withColumn("cx", F.explode(F.sequence(cell(low - reach, size), cell(high + reach, size))))
    # The edge between the two sides of the column, widened by the reach; an upright edge is taken whole.
    at = lambda x: F.col("ay") + (F.greatest(F.least(x, high), low) - F.col("ax")) * (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax"))
    y0, y1 = at(F.col("cx") * size - reach), at((F.col("cx") + 1) * size + reach)
    upright = F.col("ax") == F.col("bx")
    bottom = F.when(upright, F.least("ay", "by")).otherwise(F.least(y0, y1))
    top = F.when(upright, F.greatest("ay", "by")).otherwise(F.greatest(y0, y1))
    return by_column.withColumn("cy", F.explode(F.sequence(cell(bottom - reach, size), cell(top + reach, size))))


def outline_distances(pixels: DataFrame, zones: DataFrame, zone: str, ring: str, reach: float, size: float) -> DataFrame:
    """(row, col, zone, distance): pixels whose centre (col + 0.5, row + 0.5) is within the reach of a zone's outline."""
    at = pixels.select("row", "col").withColumns({"cx": cell(F.col("col") + 0.5, size), "cy": cell(F.col("row") + 0.5, size)})
    near = at.join(_segment_cells(zones, zone, ring, size, reach), ["cx", "cy"])
    px, py = F.col("col") + 0.5, F.col("row") + 0.5
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - F.col("ax")) * dx + (py - F.col("ay")) * dy) / square))).otherwise(0.0)
    distance = F.hypot(px - F.col("ax") - t * dx, py - F.col("ay") - t * dy)
    return near.withColumn("distance", distance).where(F.col("distance") <= reach).groupBy("row", "col", F.col("__zone").alias(zone)).agg(F.min("distance").alias("distance"))


def ring_zones(pixels: DataFrame, zones: DataFrame, zone: str, ring: str, inner: float, outer: float, size: float) -> DataFrame:
    """pixels in the ring zone of each zone, with its key and their distance: further than `inner` from its outline, no
    further than `outer`, and in no zone at all. A pixel can lie in the ring zones of several zones."""
    owned = zone_owner(pixels.select("row", "col").distinct(), zones, zone, ring, size).select("row", "col")
    free = pixels.join(owned, ["row", "col"], "left_anti")
    near = outline_distances(free.select("row", "col").distinct(), zones, zone, ring, outer, size).where(F.col("distance") > inner)
    return free.drop(*(c for c in (zone, "distance") if c in free.columns)).join(near, ["row", "col"])


def zone_background(pixels: DataFrame, zones: DataFrame, zone: str, ring: str, inner: float, outer: float, size: float, value: str, least: int = 1) -> DataFrame:
    """(zone, n_pixels, background) of every zone: the median of the values in its ring zone, null where fewer than `least`
    pixels have one. Null and NaN values do not count."""
    # Zones of one outline have one background, which is found once, under the smallest of their keys.
    outlines = cut(zones.where(real(ring)).groupBy(F.col(ring).alias(ring)).agg(F.min(zone).alias(zone)), "outlines")
    around = ring_zones(pixels.select("row", "col", value), outlines.select(zone, ring), zone, ring, inner, outer, size).where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    found = quantiles(cut(around, "around"), value, [0.5], [zone]).select(zone, "n", F.get("q", F.lit(0)).alias("median"))
    same = zones.select(F.col(zone).alias("__z"), F.col(ring).alias("__ring")).distinct()
    found = found.join(outlines, zone).join(same, F.col(ring) == F.col("__ring")).select("__z", "n", "median")
    out = zones.select(zone).distinct().join(found, F.col(zone) == F.col("__z"), "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return out.select(zone, n.alias("n_pixels"), F.when(n >= least, F.col("median")).alias("background"))


def meets_any(a: DataFrame, b: DataFrame, a_key: str, b_key: str, ring: str, size: float) -> DataFrame:
    """Rows of a with `meets`: whether any polygon of b has a point in common with it.

    One is enough. So the rows of a meet a small part of b first, about two candidates for each row, and those that are
    still without one the next part, three times as large as all before it, until all of b was tried."""
    open_, others = _stored_boxes(a, a_key, ring, "a", size), _stored_boxes(b, b_key, ring, "b", size)
    expected = cell_pairs(*_placed(open_, others, size), ["level", "cx", "cy"])
    parts = 1 << max(0, math.ceil(math.log2(max(1.0, expected / (2 * max(1, open_.count()))))))
    of = F.pmod(F.xxhash64("bk", "bring"), F.lit(parts))
    low, high, hits = 0, 1, None
    while True:
        hit = cut(_met(open_, others.where((of >= low) & (of < high)), size).select(F.col("ak").alias("__hit")).distinct(), "meets")
        hits = hit if hits is None else hits.unionByName(hit)
        low, high = high, min(4 * high, parts)
        if low >= parts:
            break
        open_ = cut(open_.join(hit, F.col("ak") == F.col("__hit"), "left_anti"), "alone")
        if open_.isEmpty():
            break
    return a.join(hits, F.col(a_key) == F.col("__hit"), "left").withColumn("meets", F.col("__hit").isNotNull()).drop("__hit")


def zone_owner(pixels: DataFrame, zones: DataFrame, zone: str, ring: str, size: float, only: bool = False) -> DataFrame:
    """Pixels (row, col) whose centre (col + 0.5, row + 0.5) lies in a polygon zone, with the zone's key: of several the
    smallest. only: pixels that several zones cover belong to none. Zones of one outline are looked at once."""
    at = pixels.withColumns({"cx": cell(F.col("col") + 0.5, size), "cy": cell(F.col("row") + 0.5, size)})
    span = lambda k: F.sequence(cell(f"z{k}0", size), cell(f"z{k}1", size))
    outlines = zones.groupBy(F.col(ring).alias("ring")).agg(F.struct(F.min(zone).alias("low"), F.max(zone).alias("high")).alias("keys"))
    placed = _boxes(outlines, "keys", "ring", "z", size).withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    inside = at.join(placed.select("cx", "cy", "zk", "zring"), ["cx", "cy"]).where(geometry.contains(F.col("zring"), F.col("col") + 0.5, F.col("row") + 0.5))
    owner = inside.groupBy("row", "col").agg(F.min("zk.low").alias(zone), F.max("zk.high").alias("__high"))
    return pixels.join(owner.where(F.col(zone) == F.col("__high") if only else F.lit(True)).drop("__high"), ["row", "col"])


def component_rings(pixels: DataFrame, key: str = "component", tolerance: float = 0.0) -> DataFrame:
    """(key, ring, area) of the largest outer ring of each (bounded) component of pixels, simplified."""
    kind = pixels.schema[key].dataType.simpleString()

    def trace(rows: pd.DataFrame) -> pd.DataFrame:
        ring = max(outline(set(zip(rows["row"].tolist(), rows["col"].tolist(), strict=True))), key=signed_area)
        ring = simplify_ring(ring, tolerance) if tolerance else ring
        return pd.DataFrame({key: [rows[key].iloc[0]], "ring": [[{"x": x, "y": y} for x, y in ring.tolist()]], "area": [abs(signed_area(ring))]})

    return pixels.select(key, "row", "col").groupBy(key).applyInPandas(trace, f"{key} {kind}, ring {RING}, area double")


def simplified(ring: Column | str, tolerance: float, closed: bool = True) -> Column:
    """Douglas-Peucker of a column of rings or (closed False) of lines."""
    one = simplify_ring if closed else simplify

    @F.pandas_udf(RING)
    def run(rings: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else [{"x": x, "y": y} for x, y in (one(points(r), tolerance) if len(r) > 2 else points(r)).tolist()] for r in rings])

    return run(ring)


def object_features(pixels: DataFrame, zones: DataFrame, zone: str, ring: str, size: float, value: str, colours: tuple[str, str, str] | None = None, green: float = 0.1) -> DataFrame:
    """One row for each zone: area and perimeter of its ring, and of its pixels their number, p10, p50, p90, mean and
    deviation of a value; with colours the indices of the mean colour, and the share of pixels whose excess green is over
    `green`. A zone without pixels has nulls for them."""
    from fieldloom.functions.scalar import colour_indices
    from fieldloom.operators.aggregates import percentile_profile

    owned = zone_owner(pixels, zones, zone, ring, size)
    out = zones.select(zone, geometry.area(ring).alias("area"), geometry.perimeter(ring).alias("perimeter"))
    stats = percentile_profile(owned, value, [zone]).select(F.col(zone).alias("__z"), F.col("n").alias("n_pixels"), "p10", "p50", "p90", "mean", "std")
    out = out.join(stats, F.col(zone) == F.col("__z"), "left").drop("__z")
    if colours:
        pixel = colour_indices(*colours)["exg"]
        mean = owned.groupBy(F.col(zone).alias("__z")).agg(*(F.avg(c).alias(f"__{c}") for c in colours), F.avg((pixel > green).cast("double")).alias("green_fraction"))
        out = out.join(mean.select("__z", "green_fraction", *(v.alias(k) for k, v in colour_indices(*(f"__{c}" for c in colours)).items())), F.col(zone) == F.col("__z"), "left").drop("__z")
    return out


def clip(ring: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """Sutherland-Hodgman: the part of a ring inside a convex, counter-clockwise one."""
    out = ring
    for a, b in zip(convex, np.roll(convex, -1, axis=0), strict=True):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        made = []
        for i in range(len(out)):
            j = (i + 1) % len(out)
            if side[i] >= 0:
                made.append(out[i])
            if (side[i] >= 0) != (side[j] >= 0):
                made.append(out[i] + (out[j] - out[i]) * side[i] / (side[i] - side[j]))
        out = np.array(made).reshape(-1, 2)
    return out

