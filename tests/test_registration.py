"""Registration of grids: subpixel shifts, the quality filter, the field between tiles, and the grid that is moved back."""

import numpy as np
import pytest

from fieldloom.operators import registration as reg

R = np.random.default_rng(5)
WAVES = [(R.uniform(-1.6, 1.6), R.uniform(-1.6, 1.6), R.uniform(0, 6)) for _ in range(60)]


def scene(y, x):
    """A field of many waves that can be asked for anywhere."""
    return sum(np.cos(p * y + q * x + r) for p, q, r in WAVES)


def frame(spark, values, keep=None):
    rows = [(int(i), int(j), float(values[i, j])) for i in range(values.shape[0]) for j in range(values.shape[1]) if keep is None or keep[i, j]]
    return spark.createDataFrame(rows, "row int, col int, value double")


Y, X = np.mgrid[0:96, 0:96].astype(float)


def test_peak_finds_parts_of_a_pixel():
    for dy, dx in ((0, 0), (2, -3), (1.3, -2.45), (-0.5, 0.25)):
        y, x = Y[:64, :64], X[:64, :64]
        found = reg.phase_peak(scene(y, x), scene(y - dy, x - dx))
        assert abs(found[0] - dy) <= 0.1 and abs(found[1] - dx) <= 0.1 and found[2] > 0.3
    assert reg.phase_peak(np.ones((8, 8)), np.ones((8, 8))) == (0.0, 0.0, 0.0)
    noise = reg.phase_peak(R.random((64, 64)), R.random((64, 64)))
    assert noise[2] < 0.2


def test_tiles_and_their_filter(spark):
    b = scene(Y - 1.25, X + 2.5)
    b[:32, :32] = R.normal(size=(32, 32)) * 8  # a corner that shows something else
    keep = np.ones((96, 96), bool)
    keep[64:, 64:] = False  # and one that shows nothing
    keep[5:9, 40:60] = False
    shifts = reg.tile_shifts(frame(spark, scene(Y, X)), frame(spark, b, keep), "value", 32, 16, 0.6)
    rows = {(r.tile_row, r.tile_col): r for r in shifts.collect()}
    assert (4, 4) not in rows and (0, 0) in rows and max(rows) <= (5, 5) and min(rows) >= (-1, -1)
    assert rows[(2, 1)].y == 2 * 16 + 15.5 and rows[(2, 1)].valid == 1.0
    good = {(r.tile_row, r.tile_col): r for r in reg.trusted(shifts, 0.2, 8.0).collect()}
    assert (0, 0) not in good and (2, 1) in good and (0, 2) in good
    clear = [r for k, r in good.items() if k[0] >= 2 and r.valid == 1.0]
    assert len(clear) >= 4 and all(abs(r.dy - 1.25) <= 0.15 and abs(r.dx + 2.5) <= 0.15 for r in clear)


def test_field_is_bilinear_and_falls_back(spark):
    size, step, middle = 8, 4, 3.5
    at = {(i, j): (i * 1.0, 10.0 - j) for i in range(3) for j in range(3) if (i, j) != (1, 1)}
    shifts = spark.createDataFrame([(i, j, dy, dx) for (i, j), (dy, dx) in at.items()], "tile_row long, tile_col long, dy double, dx double")
    places = [(r, c) for r in range(-30, 30, 3) for c in range(-30, 30, 7)]
    got = {(r.row, r.col): r for r in reg.field_at(spark.createDataFrame([(*p, "kept") for p in places], "row int, col int, note string"), shifts, size, step).collect()}
    assert len(got) == len(places) and all(r.note == "kept" for r in got.values())
    usual = np.median([v for v, _ in at.values()]), np.median([v for _, v in at.values()])
    for r, c in places:
        y, x = (r - middle) / step, (c - middle) / step
        near = [(v, max(0, 1 - abs(y - i)) * max(0, 1 - abs(x - j))) for (i, j), v in at.items()]
        total = sum(w for _, w in near)
        want = [sum(v[k] * w for v, w in near) / total if total > 1e-9 else usual[k] for k in (0, 1)]
        assert np.allclose([got[(r, c)].dy, got[(r, c)].dx], want)


def test_registered_grid_shows_the_first(spark):
    a, b = scene(Y, X), scene(Y - 1.25, X + 2.5)
    rows = reg.registered(frame(spark, a), frame(spark, b), "value", 32, 16).toPandas()
    inner = rows[rows["row"].between(16, 79) & rows["col"].between(16, 79)]
    want = a[inner["row"], inner["col"]]
    before = np.abs(b[inner["row"], inner["col"]] - want).mean()
    assert len(inner) == 64 * 64 and np.corrcoef(inner["value"], want)[0, 1] > 0.9 and np.abs(inner["value"] - want).mean() < 0.4 * before


def test_nulls_repeats_and_nothing_in_common(spark):
    a = frame(spark, scene(Y[:32, :32], X[:32, :32]))
    odd = a.unionByName(a).unionByName(spark.createDataFrame([(3, 3, None), (4, 4, float("nan"))], a.schema))
    one, two = (reg.tile_shifts(a, x, "value", 32, 32).collect() for x in (a, odd))
    assert one == two and (one[0].dy, one[0].dx) == (0.0, 0.0)
    with pytest.raises(ValueError, match="no tile"):
        reg.registered(a, a.where("false"), "value", 32, 32)
    with pytest.raises(ValueError, match="no tile"):
        reg.registered(a.where("false"), a, "value", 32, 32)


def test_a_whole_shift_is_found_exactly_in_noise():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        grid = rng.normal(size=(40, 40))
        dy, dx, response = reg.phase_peak(grid[4:36, 4:36], grid[2:34, 7:39])
        assert (dy, dx) == (2.0, -3.0)
        assert response > 0.5
