"""Raster grids as sparse pixel rows (row, col, value): resampling, neighbourhoods, components, fields.

Neighbourhood operations send each pixel to the cells it touches and aggregate there, so a pixel's work is bounded by
the window and no task needs a whole raster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.scalar import affine
from fieldloom.operators.aggregates import quantiles
from fieldloom.sources.store import cut, drop


def window(df: DataFrame, row0: int, col0: int, rows: int, cols: int, tile: int | None = None) -> DataFrame:
    """Pixels of a window. tile: size of the tiles by which the table is partitioned (tile_row, tile_col), for pruning."""
    out = df.where(F.col("row").between(row0, row0 + rows - 1) & F.col("col").between(col0, col0 + cols - 1))
    if tile:
        out = out.where(F.col("tile_row").between(row0 // tile, (row0 + rows - 1) // tile) & F.col("tile_col").between(col0 // tile, (col0 + cols - 1) // tile))
    return out


def tiled(df: DataFrame, tile: int) -> DataFrame:
    return df.withColumns({"tile_row": F.floor(F.col("row") / tile).cast("int"), "tile_col": F.floor(F.col("col") / tile).cast("int")})


def block_average(df: DataFrame, k: int, values: Sequence[str], least_valid: float = 0.0) -> DataFrame:
    """Mean of k by k blocks; null where the share of valid pixels is below the least."""
    cells = df.groupBy(F.floor(F.col("row") / k).cast("int").alias("row"), F.floor(F.col("col") / k).cast("int").alias("col"))
    return cells.agg(*(F.when(F.count(v) >= least_valid * k * k, F.avg(v)).alias(v) for v in values), F.count("*").alias("n"))


def alpha_average(df: DataFrame, k: int, values: Sequence[str], alpha: str) -> DataFrame:
    """Block means weighted by alpha, and the mean alpha of the whole block."""
    cells = df.groupBy(F.floor(F.col("row") / k).cast("int").alias("row"), F.floor(F.col("col") / k).cast("int").alias("col"))
    return cells.agg(*((F.sum(F.col(v) * F.col(alpha)) / F.nullif(F.sum(alpha).cast("double"), F.lit(0.0))).alias(v) for v in values), (F.sum(alpha) / (k * k)).alias(alpha))


def pyramid(df: DataFrame, value: str, zoom: int, levels: int) -> DataFrame:
    """Means at each zoom level from `zoom` down, each from the level below it: (z, row, col, value)."""
    level, out = df.select(F.lit(zoom).alias("z"), "row", "col", value), None
    for k in range(levels + 1):
        out = level if out is None else out.unionByName(level)
        if k < levels:
            level = level.groupBy((F.col("z") - 1).alias("z"), F.shiftright("row", 1).alias("row"), F.shiftright("col", 1).alias("col")).agg(F.avg(value).alias(value))
    return out


def _spread(df: DataFrame, value: str, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    """Each pixel at the places of the pixels that see it by one of the offsets."""
    moves = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets))
    return df.where(F.col(value).isNotNull()).withColumn("__o", F.explode(moves)).select((F.col("row") + F.col("__o.a")).alias("row"), (F.col("col") + F.col("__o.b")).alias("col"), F.col("__o.a").alias("dr"), F.col("__o.b").alias("dc"), F.col(value).alias("__v"))


def _square(reach: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]


def local_extreme(df: DataFrame, value: str, reach: int, largest: bool = True, out: str = "extreme") -> DataFrame:
    """Largest (or smallest) value in the square around each pixel, along rows and then along columns."""
    pick = F.max if largest else F.min
    rows = _spread(df, value, [(0, b) for b in range(-reach, reach + 1)]).groupBy("row", "col").agg(pick("__v").alias("__v"))
    both = _spread(rows, "__v", [(a, 0) for a in range(-reach, reach + 1)]).groupBy("row", "col").agg(pick("__v").alias(out))
    return df.join(both, ["row", "col"], "left")


def local_maxima(df: DataFrame, value: str, reach: int, least: float) -> DataFrame:
    """Pixels that no pixel in the square around exceeds and that reach the least; of equal ones the first by row, col."""
    top = local_extreme(df, value, reach).where((F.col(value) == F.col("extreme")) & (F.col(value) >= least)).drop("extreme")
    rivals = _spread(top, value, [o for o in _square(reach) if o > (0, 0)]).select("row", "col", F.col("__v").alias(value))
    return top.join(rivals, ["row", "col", value], "left_anti")


def opening(df: DataFrame, value: str, reach: int, out: str = "opened") -> DataFrame:
    low = local_extreme(df, value, reach, largest=False, out="__low")
    return local_extreme(low, "__low", reach, out=out).drop("__low")


def closing(df: DataFrame, value: str, reach: int, out: str = "closed") -> DataFrame:
    high = local_extreme(df, value, reach, out="__high")
    return local_extreme(high, "__high", reach, largest=False, out=out).drop("__high")


def black_top_hat(df: DataFrame, value: str, reach: int, cap: float | None = None, out: str = "top_hat") -> DataFrame:
    """Closing less the value: how much darker a pixel is than what surrounds it; capped at a percentile."""
    found = closing(df, value, reach).withColumn(out, F.col("closed") - F.col(value)).drop("closed")
    if cap is None:
        return found
    found = cut(found, "top-hat")
    most = quantiles(found, out, [cap]).agg(F.max(F.col("q")[0]).alias("__cap"))
    return found.crossJoin(F.broadcast(most)).withColumn(out, F.least(out, "__cap")).drop("__cap")


def smooth(df: DataFrame, value: str, sigma: float, truncate: float = 3.0, out: str = "smoothed") -> DataFrame:
    """Normalised Gaussian mean that leaves missing pixels out, as two passes along the axes."""
    reach = max(1, int(truncate * sigma + 0.5))
    weight = lambda c: F.exp(-F.pow(F.col(c).cast("double"), F.lit(2.0)) / (2 * sigma * sigma))
    one = _spread(df, value, [(0, b) for b in range(-reach, reach + 1)]).groupBy("row", "col").agg(F.sum(F.col("__v") * weight("dc")).alias("__v"), F.sum(weight("dc")).alias("__w"))
    moves = F.array(*(F.lit(a) for a in range(-reach, reach + 1)))
    w = F.exp(-F.pow(F.col("__a").cast("double"), F.lit(2.0)) / (2 * sigma * sigma))
    two = one.withColumn("__a", F.explode(moves)).groupBy((F.col("row") + F.col("__a")).alias("row"), "col").agg((F.sum(F.col("__v") * w) / F.sum(F.col("__w") * w)).alias(out))
    return df.join(two, ["row", "col"], "left")


def _runs(df: DataFrame) -> DataFrame:
    """Stored runs of pixels along the rows: row, a, b (first and last column), id (row * 2**31 + first column)."""
    place = F.row_number().over(Window.partitionBy("row").orderBy("col"))
    runs = df.select("row", "col").distinct().withColumn("__g", F.col("col") - place).groupBy("row", "__g").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    return cut(runs.select("row", "a", "b", (F.col("row").cast("long") * (1 << 31) + F.col("a")).alias("id")), "runs")


def _run_labels(runs: DataFrame, corners: bool) -> DataFrame:
    """(id, label) of stored runs: the smallest id of those that are connected."""
    above = runs.select((F.col("row") + 1).alias("row"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("id").alias("up"))
    links = runs.join(above, "row").where((F.col("pa") <= F.col("b") + int(corners)) & (F.col("pb") >= F.col("a") - int(corners))).select(F.col("id").alias("u"), F.col("up").alias("v"))
    edges = cut(links.union(links.select("v", "u")), "links")
    label, before = cut(runs.select(F.col("id").alias("u"), F.col("id").alias("label")), "labels"), None
    while True:
        near = edges.join(label.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = cut(label.join(near, "u", "left").select("u", F.least("label", F.coalesce("near", "label")).alias("label")), "labels")
        drop(label)
        # Jump to the label of the label: long components take few rounds.
        label = cut(lower.join(lower.select(F.col("u").alias("label"), F.col("label").alias("top")), "label").select("u", F.col("top").alias("label")), "labels")
        drop(lower)
        mark = label.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if mark == before:
            drop(edges)
            return label.withColumnRenamed("u", "id")
        before = mark


def components(df: DataFrame, out: str = "component", corners: bool = True) -> DataFrame:
    """Connected components of pixel rows (row, col): runs of each row, linked to those of the row before. corners:
    whether pixels that meet at a corner only are connected.

    The number of a component is the smallest of its runs' numbers (row * 2**31 + first column).
    """
    runs = _runs(df)
    named = runs.join(_run_labels(runs, corners), "id")
    return named.select("row", F.explode(F.sequence("a", "b")).alias("col"), F.col("label").alias(out))


def fill_holes(df: DataFrame) -> DataFrame:
    """The pixels (row, col) and those that they enclose: free pixels that no path along edges joins to the outside.

    Only the gaps between two runs of a row can be enclosed, so work follows the runs and not the extent: gaps are linked
    to those of the next row, and one that lies beyond the ends of a neighbouring row, or beside an empty row, is open, with
    all that it is linked to."""
    runs = _runs(df)
    before = F.lag("b").over(Window.partitionBy("row").orderBy("a"))
    gaps = cut(runs.withColumn("__p", before).where("__p IS NOT NULL").select("row", (F.col("__p") + 1).alias("a"), (F.col("a") - 1).alias("b"), (F.col("row").cast("long") * (1 << 31) + F.col("__p") + 1).alias("id")), "gaps")
    ends = runs.groupBy("row").agg(F.min("a").alias("low"), F.max("b").alias("high"))
    beside = gaps.select("id", "a", "b", F.explode(F.array(F.col("row") - 1, F.col("row") + 1)).alias("row")).join(ends, "row", "left")
    open_ = beside.where(F.col("low").isNull() | (F.col("a") < F.col("low")) | (F.col("b") > F.col("high"))).select("id").distinct()
    labels = _run_labels(gaps, False)
    outside = labels.join(open_, "id").select("label").distinct()
    holes = gaps.join(labels.join(outside, "label", "left_anti"), "id").select("row", F.explode(F.sequence("a", "b")).alias("col"))
    return df.select("row", "col").distinct().unionByName(holes)


def boundless(df: DataFrame, row0: int, col0: int, rows: int, cols: int, value: str, fill: float | None = None) -> DataFrame:
    """All pixels of a window, those outside the grid or without a value filled."""
    frame = df.sparkSession.range(rows).select((F.col("id") + row0).cast("int").alias("row"), F.explode(F.sequence(F.lit(col0), F.lit(col0 + cols - 1))).alias("col"))
    return frame.join(window(df, row0, col0, rows, cols).select("row", "col", value), ["row", "col"], "left").select("row", "col", F.coalesce(value, F.lit(fill).cast("double")).alias(value))


def component_stats(pixels: DataFrame, key: str = "component") -> DataFrame:
    return pixels.groupBy(key).agg(F.count("*").alias("area"), F.min("row").alias("min_row"), F.min("col").alias("min_col"), F.max("row").alias("max_row"), F.max("col").alias("max_col"), F.avg("row").alias("mean_row"), F.avg("col").alias("mean_col"))


def shape(df: DataFrame, key: str) -> DataFrame:
    """Pixel area, hull solidity and elongation of the smallest rectangle around each component (bounded patches)."""

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        corners = {(r + a, c + b) for r, c in zip(rows["row"], rows["col"], strict=True) for a in (0, 1) for b in (0, 1)}
        points = sorted(corners)

        def half(items):
            out: list[tuple[int, int]] = []
            for p in items:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        hull = np.array(half(points) + half(points[::-1]), dtype=float)
        after = np.roll(hull, -1, axis=0)
        hull_area = abs((hull[:, 0] * after[:, 1] - after[:, 0] * hull[:, 1]).sum()) / 2
        best = None
        for angle in np.arctan2(*(after - hull).T[::-1]):
            turned = hull @ np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
            w, h = np.ptp(turned, axis=0)
            if best is None or w * h < best[0] * best[1]:
                best = (w, h)
        return pd.DataFrame({key: [rows[key].iloc[0]], "area": [len(rows)], "solidity": [len(rows) / hull_area], "elongation": [max(best) / min(best)]})

    return df.select(key, "row", "col").distinct().groupBy(key).applyInPandas(measure, f"{key} {df.schema[key].dataType.simpleString()}, area long, solidity double, elongation double")


def sample_every(df: DataFrame, k: int) -> DataFrame:
    return df.where((F.pmod("row", F.lit(k)) == 0) & (F.pmod("col", F.lit(k)) == 0))


def idw(targets: DataFrame, controls: DataFrame, value: str, power: float = 2.0, max_controls: int = 10_000) -> DataFrame:
    """Inverse-distance-weighted value at each target (row, col) from all control points. They go to the tasks in blocks
    of about max_controls, whose partial sums are added."""
    # Equal points are one point that counts more than once, so that hashes deal the blocks evenly; so are equal targets.
    c = controls.groupBy(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    names = targets.columns
    targets = targets.groupBy(*names).agg(F.count("*").alias("__times"))
    w = F.col("__n") / (F.pow(F.hypot(F.col("row") - F.col("__r"), F.col("col") - F.col("__c")), F.lit(power)) + 1e-12)
    blocks, sums = max(1, -(-c.count() // max_controls)), None
    for block in range(blocks):
        part = c if blocks == 1 else c.where(F.pmod(F.xxhash64("__r", "__c", "__v"), F.lit(blocks)) == block)
        one = targets.crossJoin(F.broadcast(part)).groupBy(*targets.columns).agg(F.sum(w * F.col("__v")).alias("__wv"), F.sum(w).alias("__w"))
        one = one if blocks == 1 else cut(one, "idw")
        sums = one if sums is None else sums.unionByName(one)
    if blocks > 1:
        sums = sums.groupBy(*targets.columns).agg(F.sum("__wv").alias("__wv"), F.sum("__w").alias("__w"))
    return sums.withColumn("__times", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*names, (F.col("__wv") / F.col("__w")).alias(value))


def warp(df: DataFrame, targets: DataFrame, value: str) -> DataFrame:
    """Bilinear values at shifted places. targets: row, col, y, x (source place); missing neighbours leave out their weight."""
    places = targets.groupBy("row", "col", "y", "x").agg(F.count("*").cast("int").alias("__times"))
    near = places.withColumns({"__y": F.floor("y"), "__x": F.floor("x")}).withColumn("__o", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))))
    fy, fx = F.col("y") - F.col("__y"), F.col("x") - F.col("__x")
    w = F.when(F.col("__o.a") == 1, fy).otherwise(1 - fy) * F.when(F.col("__o.b") == 1, fx).otherwise(1 - fx)
    asked = near.select("row", "col", "y", "x", "__times", (F.col("__y") + F.col("__o.a")).alias("sr"), (F.col("__x") + F.col("__o.b")).alias("sc"), w.alias("w"))
    source = df.where(F.col(value).isNotNull()).select(F.col("row").alias("sr"), F.col("col").alias("sc"), value)
    found = asked.join(source, ["sr", "sc"]).where("w > 0").groupBy("row", "col", "y", "x", "__times").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias(value))
    return found.withColumn("__times", F.explode(F.sequence(F.lit(1), "__times"))).select("row", "col", value)


def phase_shifts(tiles: DataFrame, key: str, size: int) -> DataFrame:
    """Shift of b against a of each tile by phase correlation. tiles: key, a, b (arrays of size * size doubles);
    gives dy, dx (whole pixels) and the height of the peak."""

    def run(batches):
        for rows in batches:
            out = []
            for k, a, b in zip(rows[key], rows["a"], rows["b"], strict=True):
                fa, fb = (np.fft.fft2(np.asarray(v, dtype=float).reshape(size, size) - np.mean(v)) for v in (a, b))
                cross = np.conj(fa) * fb
                peak = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
                y, x = np.unravel_index(int(peak.argmax()), peak.shape)
                out.append((k, y - size if y > size // 2 else y, x - size if x > size // 2 else x, float(peak.max())))
            yield pd.DataFrame(out, columns=[key, "dy", "dx", "response"])

    return tiles.select(key, "a", "b").mapInPandas(run, f"{key} {tiles.schema[key].dataType.simpleString()}, dy int, dx int, response double")


def angle_profiles(df: DataFrame, value: str, angles: Sequence[float], bin_size: float = 1.0) -> DataFrame:
    """For each angle (degrees) the variance of the means of the lines across, each line counted with its pixels (short
    ones in the corners say little): angle, variance, bins. It is at most the variance of the pixels.

    A task adds its pixels up by angle and bin before anything is exchanged, so what travels is a row for each angle and
    bin of a task, whatever the number of pixels. Null and NaN values are left out.
    """
    turns = [(float(a), math.cos(math.radians(a)), math.sin(math.radians(a))) for a in angles]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = [pd.DataFrame({"s": [], "n": []})] * len(turns)
        for rows in batches:
            row, col, v = (rows[c].to_numpy(dtype=float) for c in ("row", "col", "v"))
            for k, (_, cos, sin) in enumerate(turns):
                # A pixel on the edge of two bins is in the upper one, however its place was rounded.
                bins, at = np.unique(np.floor((col * cos + row * sin) / bin_size + 1e-9).astype(np.int64), return_inverse=True)
                one = pd.DataFrame({"s": np.bincount(at, v), "n": np.bincount(at).astype(float)}, index=bins)
                held[k] = held[k].add(one, fill_value=0.0)
        for (angle, _, _), part in zip(turns, held, strict=True):
            yield pd.DataFrame({"angle": angle, "bin": part.index.astype("int64"), "s": part["s"].to_numpy(), "n": part["n"].to_numpy()})

    v = F.col(value).cast("double")
    parts = df.where(v.isNotNull() & ~F.isnan(v)).select("row", "col", v.alias("v")).mapInPandas(run, "angle double, bin long, s double, n double")
    lines = parts.groupBy("angle", "bin").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    mean = F.sum("s") / F.sum("n")
    return lines.groupBy("angle").agg((F.sum(F.col("s") * F.col("s") / F.col("n")) / F.sum("n") - mean * mean).alias("variance"), F.count("*").alias("bins"))


def dominant_angle(df: DataFrame, value: str, angles: Sequence[float], bin_size: float = 1.0) -> DataFrame:
    """The angle (degrees) whose profile across varies most; of equal ones the smallest."""
    return angle_profiles(df, value, angles, bin_size).select("angle", "variance").orderBy(F.desc("variance"), "angle").limit(1)


def orientation(df: DataFrame, value: str, steps: Sequence[float] = (3.0, 0.3, 0.05), bin_size: float = 1.0) -> DataFrame:
    """The dominant angle of half a turn, coarse and then finer: each further step looks one former step to both sides.
    One row (angle in [0, 180), variance), none for a table without values. The table is read once a step."""
    steps = [float(x) for x in steps]
    best = dominant_angle(df, value, [k * steps[0] for k in range(math.ceil(180 / steps[0] - 1e-9))], bin_size).first()
    for before, step in zip(steps[:-1], steps[1:], strict=True):
        if best is None:
            break
        reach = math.ceil(before / step - 1e-9)
        best = dominant_angle(df, value, [best.angle + k * step for k in range(-reach, reach + 1)], bin_size).first()
    rows = [] if best is None else [(best.angle % 180.0, best.variance)]
    return df.sparkSession.createDataFrame(rows, "angle double, variance double")


def pixel_centres(df: DataFrame, transform: Sequence[float]) -> DataFrame:
    x, y = affine(*transform, "col", "row")
    return df.withColumns({"x": x, "y": y})


def no_data(c: str, sentinel: float, low: float, high: float) -> Column:
    """The sentinel, values out of range and values that are not finite become null."""
    v = F.col(c)
    return F.when(~F.isnan(v) & (v != sentinel) & v.between(low, high), v)


def crop(targets: DataFrame, tiles: DataFrame, key: str, size: int, tile: int) -> DataFrame:
    """Pixels of a square of `size` around each target (key, row, col): joined by tile, so each tile is read once."""
    half = size // 2
    span = lambda c: F.sequence(F.floor((F.col(c) - half) / tile), F.floor((F.col(c) - half + size - 1) / tile))
    asked = targets.select(key, F.col("row").alias("__r"), F.col("col").alias("__c")).withColumn("tile_row", F.explode(span("__r"))).withColumn("tile_col", F.explode(span("__c")))
    got = asked.join(tiles.withColumns({"tile_row": F.col("tile_row").cast("long"), "tile_col": F.col("tile_col").cast("long")}), ["tile_row", "tile_col"])
    dr, dc = F.col("row") - F.col("__r") + half, F.col("col") - F.col("__c") + half
    return got.where(dr.between(0, size - 1) & dc.between(0, size - 1)).withColumns({"crop_row": dr, "crop_col": dc}).drop("__r", "__c", "tile_row", "tile_col")
