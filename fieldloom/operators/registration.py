"""Registration of two grids of the same place: shifts of overlapping tiles, a field of shifts, and the second grid
brought onto the first.

Grids are pixel rows (row, col, value). Tile (i, j) covers rows from i * step and columns from j * step on, `size` of
each, so a pixel is in at most ceil(size / step) squared tiles and a task holds one tile at a time. The field between
the centres of four tiles is bilinear, and every pixel meets its four tiles by one equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.aggregates import quantiles
from fieldloom.operators.grid import warp
from fieldloom.sources.store import cut

FIELD = "tile_row long, tile_col long, y double, x double, valid double, dy double, dx double, response double"
CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))


def _phases(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Phases of b against a, both Hann-windowed; frequencies without energy in either count little. None: no energy."""
    hann = np.outer(*(np.sin(np.pi * (np.arange(n) + 0.5) / n) ** 2 for n in a.shape))
    fa, fb = (np.fft.fft2((v - v.mean()) * hann) for v in (a, b))
    cross = np.conj(fa) * fb
    size = np.abs(cross)
    return cross / (size + 1e-3 * size.max()) if size.max() > 0 else None


def _fine(cross: np.ndarray, at: tuple[int, int], upsample: int) -> tuple[float, float, float]:
    """The peak on a mesh of 1 / upsample around a whole shift, by the transform at just those places, and its height."""
    fy, fx = (np.fft.fftfreq(n) for n in cross.shape)
    mesh = np.arange(-upsample, upsample + 1) / upsample
    ys, xs = at[0] + mesh, at[1] + mesh
    fine = (np.exp(2j * np.pi * np.outer(ys, fy)) @ cross @ np.exp(2j * np.pi * np.outer(fx, xs))).real
    i, j = np.unravel_index(int(fine.argmax()), fine.shape)
    return float(ys[i]), float(xs[j]), float(fine[i, j] / np.abs(cross).sum())


def phase_peak(a: np.ndarray, b: np.ndarray, upsample: int = 20) -> tuple[float, float, float]:
    """Shift (dy, dx) of b against a, to 1 / upsample of a pixel, and the height of the peak (1: nothing but a shift).

    The peak is found on whole pixels first. What each tile shows and the other does not pulls a peak aside, so the mesh
    around it is laid over the part that both show at that whole shift.
    """
    cross = _phases(a, b)
    if cross is None:
        return 0.0, 0.0, 0.0
    whole = np.fft.ifft2(cross).real
    at = tuple(int(p) - (n if p > n // 2 else 0) for p, n in zip(np.unravel_index(int(whole.argmax()), whole.shape), a.shape, strict=True))
    found = _fine(cross, at, upsample)
    mine, other = (tuple(slice(max(0, s * d), n - max(0, -s * d)) for d, n in zip(at, a.shape, strict=True)) for s in (-1, 1))
    shared = _phases(a[mine], b[other])
    if shared is None:
        return found
    dy, dx, _ = _fine(shared, (0, 0), upsample)
    return at[0] + dy, at[1] + dx, found[2]


def tile_shifts(a: DataFrame, b: DataFrame, value: str, size: int, step: int, least_valid: float = 0.5) -> DataFrame:
    """Shift of b against a in each tile: tile_row, tile_col, its centre (y, x), the share of pixels that both grids have,
    dy, dx and the response. Tiles with a smaller share than least_valid are left out.

    Null and NaN values are missing and take the mean of the tile; a pixel that is there more than once is averaged.
    """
    v = F.col(value).cast("double")
    known = lambda df, mine, other: df.where(v.isNotNull() & ~F.isnan(v)).select("row", "col", v.alias(mine), F.lit(None).cast("double").alias(other))
    both = known(a, "a", "b").unionByName(known(b, "b", "a")).groupBy("row", "col").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    over = lambda c: F.sequence(F.floor((F.col(c) - size) / step) + 1, F.floor(F.col(c) / step))
    # Explodes of two columns: a pixel goes to the tiles that cover it, and only to those.
    dealt = both.withColumn("tile_row", F.explode(over("row"))).withColumn("tile_col", F.explode(over("col")))
    place = ((F.col("row") - F.col("tile_row") * step) * size + F.col("col") - F.col("tile_col") * step).cast("int")
    shared = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.lit(float(size * size))
    tiles = dealt.groupBy("tile_row", "tile_col").agg(shared.alias("valid"), F.collect_list(F.struct(place.alias("k"), "a", "b")).alias("p")).where(F.col("valid") >= least_valid)
    flat = tiles.select("tile_row", "tile_col", "valid", *(F.col(f"p.{k}").alias(k) for k in ("k", "a", "b")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for t in rows.itertuples(index=False):
                pair = []
                for values in (t.a, t.b):
                    grid = np.full(size * size, np.nan)
                    grid[np.asarray(t.k)] = np.asarray(values, dtype=float)
                    pair.append(np.where(np.isnan(grid), np.nanmean(grid) if (~np.isnan(grid)).any() else 0.0, grid).reshape(size, size))
                middle = (size - 1) / 2
                out.append((t.tile_row, t.tile_col, t.tile_row * step + middle, t.tile_col * step + middle, t.valid, *phase_peak(*pair)))
            yield pd.DataFrame(out, columns=["tile_row", "tile_col", "y", "x", "valid", "dy", "dx", "response"])

    return flat.mapInPandas(run, FIELD)


def trusted(shifts: DataFrame, least_response: float, most_shift: float) -> DataFrame:
    """Tiles whose peak is high enough and whose shift is not larger than expected."""
    return shifts.where((F.col("response") >= least_response) & (F.hypot("dy", "dx") <= most_shift))


def field_at(places: DataFrame, shifts: DataFrame, size: int, step: int) -> DataFrame:
    """places (row, col, ...) with dy, dx: bilinear between the centres of the tiles around, those that are missing left
    out with their weight; the median shift of all tiles where none is there, and null without any tile."""
    middle = (size - 1) / 2
    cell = lambda c: F.floor((F.col(c) - middle) / step)
    corner = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in CORNERS))
    around = shifts.withColumn("__k", F.explode(corner)).groupBy((F.col("tile_row") - F.col("__k.i")).alias("__cr"), (F.col("tile_col") - F.col("__k.j")).alias("__cc"))
    pick = lambda c, i, j: F.max(F.when((F.col("__k.i") == i) & (F.col("__k.j") == j), F.col(c))).alias(f"__{c}{i}{j}")
    cells = around.agg(*(pick(c, i, j) for c in ("dy", "dx") for i, j in CORNERS))
    # Two numbers, from exact ranks that no one task sorts.
    mid = lambda c: quantiles(shifts, c, [0.5]).agg(F.max(F.col("q")[0]).alias(f"__m{c}"))
    usual = mid("dy").crossJoin(mid("dx"))
    found = places.withColumns({"__cr": cell("row"), "__cc": cell("col")}).join(cells, ["__cr", "__cc"], "left").crossJoin(F.broadcast(usual))
    ty, tx = ((F.col(c) - middle) / step - F.col(k) for c, k in (("row", "__cr"), ("col", "__cc")))

    def blend(c: str) -> Column:
        pairs = [(F.col(f"__{c}{i}{j}"), (ty if i else 1 - ty) * (tx if j else 1 - tx)) for i, j in CORNERS]
        total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in pairs), F.lit(0.0))
        held = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in pairs), F.lit(0.0))
        return F.when(total > 1e-9, held / F.nullif(total, F.lit(0.0))).otherwise(F.col(f"__m{c}")).alias(c)

    return found.select(*(F.col(f"`{c}`") for c in places.columns), blend("dy"), blend("dx"))


def registered(a: DataFrame, b: DataFrame, value: str, size: int = 64, step: int = 32, least_valid: float = 0.5, least_response: float = 0.2, most_shift: float | None = None) -> DataFrame:
    """(row, col, value): what b shows at each pixel of a, once the shifts between them are taken out.

    most_shift: a quarter of the tile by default. ValueError where no tile is trusted, as there is nothing to go by.
    Pixels that b has nothing for are left out.
    """
    shifts = cut(trusted(tile_shifts(a, b, value, size, step, least_valid), least_response, size / 4 if most_shift is None else most_shift), "shifts")
    if shifts.isEmpty():
        raise ValueError("no tile has a shift that can be trusted")
    # To a thousandth of a pixel, so that a whole shift asks for whole pixels.
    place = lambda c, d: (F.col(c) + F.round(d, 3)).alias({"row": "y", "col": "x"}[c])
    targets = field_at(a.select("row", "col").distinct(), shifts, size, step).select("row", "col", place("row", "dy"), place("col", "dx"))
    known = b.where(~F.isnan(F.col(value).cast("double"))).groupBy("row", "col").agg(F.avg(value).alias(value))
    return warp(known, targets, value)
