"""Operators that SQL cannot express, and edge cases, against small sequential versions."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry, scalar
from fieldloom.operators import aggregates, grid, ml, relational, selection, sequence, spatial
from fieldloom.plans.runner import Runner, newest_first, queue_positions, queue_status, recover
from fieldloom.sources import files
from fieldloom.sources.store import cut
from fieldloom.streaming import events


def test_suppression_equals_sequential(spark):
    r = random.Random(1)
    boxes = [(i, x := r.randrange(60), y := r.randrange(60), x + r.choice([0, 5, 9, 14]), y + r.choice([4, 9]), r.randrange(4)) for i in range(70)]
    df = spark.createDataFrame([(b[0], *(float(v) for v in b[1:5]), b[5]) for b in boxes], "k0 long, x0 double, y0 double, x1 double, y1 double, p long")
    edges = spatial.box_overlaps(df, "k0", 7.0).where("ratio > 0.25")

    def ratio(a, b):
        w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
        area = min((a[3] - a[1]) * (a[4] - a[2]), (b[3] - b[1]) * (b[4] - b[2]))
        return w * h / area if w > 0 and h > 0 else 0

    kept = []
    for b in sorted(boxes, key=lambda b: (-b[5], b[0])):
        if all(ratio(b, k) <= 0.25 for k in kept):
            kept.append(b)
    assert sorted(x.k0 for x in spatial.suppress(df, "k0", "p", edges).collect()) == sorted(b[0] for b in kept)
    assert spatial.suppress(df.limit(0), "k0", "p", edges.limit(0)).count() == 0


def test_greedy_match_equals_sequential(spark):
    r = random.Random(2)
    a = [(i, float(r.randrange(30)), float(r.randrange(30))) for i in range(50)]
    b = [(i, float(r.randrange(30)), float(r.randrange(30))) for i in range(40)]
    edges = sorted((math.hypot(p[1] - q[1], p[2] - q[2]), p[0], q[0]) for p in a for q in b if math.hypot(p[1] - q[1], p[2] - q[2]) <= 6)
    left, right, want = set(), set(), []
    for _, i, j in edges:
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            want.append((i, j))
    got = spatial.greedy_match(spark.createDataFrame(a, "i0 long, x double, y double"), spark.createDataFrame(b, "j0 long, x double, y double"), "i0", "j0", 6.0).collect()
    assert sorted((x.i0, x.j0) for x in got) == sorted(want)


def test_chain_equals_search_over_all_subsets(spark):
    r = random.Random(3)
    rows = [(line, float(x), r.choice([-0.5, 0.2, 0.7, 1.0])) for line in range(6) for x in sorted(r.sample(range(40), 7))]
    got = sequence.chain_select(spark.createDataFrame(rows, "line long, x double, s double"), "line", "x", "s", 5.0, 2.0).collect()

    def value(chain):
        steps = [(b[1] - a[1]) / 5.0 for a, b in zip(chain, chain[1:])]
        return sum(c[2] for c in chain) - sum(2.0 * (s - max(1, round(s))) ** 2 for s in steps)

    for line in range(6):
        own = [t for t in rows if t[0] == line]
        best = max(value([own[i] for i in range(7) if m >> i & 1]) for m in range(1, 128))
        mine = sorted((tuple(t) for t in got if t.line == line), key=lambda t: t[1])
        assert (value(mine) if mine else 0) == pytest.approx(max(best, 0))


def test_chain_peaks_tracks_and_groups(spark):
    rows = [(1, float(i), v) for i, v in enumerate([0.0, 3.0, 1.0, 5.0, 4.5, 5.0, 0.0, 2.0, 0.0])]
    got = sequence.peaks(spark.createDataFrame(rows, "line long, at double, v double"), "line", "at", "v", 2.0, 1.0).orderBy("at").collect()
    assert [x.at for x in got] == [1.0, 3.0, 5.0, 7.0]
    apart = sequence.peaks(spark.createDataFrame(rows, "line long, at double, v double"), "line", "at", "v", 2.5, 2.5)
    assert [x.at for x in apart.collect()] == [3.0]
    seen = spark.createDataFrame([(0, 1.0), (0, 9.0), (1, 1.4), (1, 9.3), (2, 9.5), (4, 1.5), (9, 1.5)], "block long, at double")
    got = {(x.block, x.at): x.track for x in sequence.link_tracks(seen, "block", "at", 1.0, 3).collect()}
    assert got == {(0, 1.0): 0, (0, 9.0): 1, (1, 1.4): 0, (1, 9.3): 1, (2, 9.5): 1, (4, 1.5): 0, (9, 1.5): 2}
    g = sequence.seeded_groups(spark.createDataFrame([(1, 0.0), (1, 2.0), (1, 4.0), (1, 5.5)], "line long, x double"), "line", "x", 3.0)
    assert [x.group for x in g.orderBy("x").collect()] == [1, 1, 2, 2]


def test_line_distances(spark):
    k = spark.createDataFrame([(1, 0.0, [0.0, 10.0], [1.0, 1.0]), (2, 1.0, [0.0, 10.0], [3.0, 5.0])], "line long, at double, xs array<double>, ys array<double>")
    assert [tuple(r) for r in sequence.line_distances(k, "line", "at", [0.0, 5.0, 10.0], "xs", "ys").collect()] == [(1, 3.0)]


def test_rings(spark):
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    one = spark.range(1).select(geometry.ring(ring).alias("r"))
    got = one.select(geometry.signed_area("r").alias("a"), geometry.perimeter("r").alias("p"), geometry.centroid("r").alias("c"), geometry.contains(F.col("r"), F.lit(2.0), F.lit(0.5)).alias("i"), geometry.contains(F.col("r"), F.lit(2.0), F.lit(3.0)).alias("o"), geometry.contains(F.col("r"), F.lit(9.0), F.lit(0.5)).alias("b"), geometry.length("r").alias("l")).first()
    assert got.a == 10 and got.i and not got.o and not got.b
    assert got.p == pytest.approx(4 + 4 + 2 * math.hypot(2, 3) + 4) and got.l == pytest.approx(got.p - 4)
    assert got.c.x == pytest.approx(2.0)
    flat = spark.range(1).select(geometry.ring([(1, 1), (2, 2)]).alias("r"))
    assert flat.select(geometry.area("r"), geometry.centroid("r")).first()[:] == (0.0, (1.5, 1.5))
    degrees = spark.range(1).select(geometry.geodesic_area(geometry.ring([(10, 0), (10.01, 0), (10.01, 0.01), (10, 0.01)]))).first()[0]
    assert degrees == pytest.approx(1111.95**2, rel=1e-3)


def test_interpolation_is_numpys(spark):
    xs, ys = [0.0, 1.0, 4.0], [5.0, 7.0, 1.0]
    q = spark.createDataFrame([(float(v),) for v in (-1, 0, 0.5, 1, 3, 4, 9)], "x double").select("x", geometry.interpolate(F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys)), "x").alias("y")).collect()
    assert all(r.y == pytest.approx(np.interp(r.x, xs, ys)) for r in q)


def test_scores_with_nulls_and_no_spread(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0), (4, 9.0), (5, None)], "k long, v double")
    got = {r.k: r.z for r in aggregates.robust_z(df, "v", "z").collect()}
    assert got[1] == pytest.approx((5 - 6) / math.sqrt(3) * 0 + (5 - 5) / 1, abs=1e-9) and got[4] == pytest.approx(4 / np.std([5, 5, 5, 9])) and got[5] is None
    same = aggregates.robust_z(df.where("v = 5"), "v", "z").collect()
    assert {r.z for r in same} == {0.0}
    assert aggregates.auc(df.withColumn("y", F.lit(True)), "v", F.col("y")).first().auc is None
    h = {r.bin: r.n for r in aggregates.histogram(spark.createDataFrame([(x,) for x in (-5.0, 0.0, 0.99, 1.0, 3.0, 99.0, float("nan"), None)], "v double"), "v", 0.0, 4.0, 4).collect()}
    assert h == {0: 3, 1: 1, 2: 0, 3: 2}
    p = aggregates.group_profile(df.withColumn("g", F.lit(1)), "g", "v", "v", F.col("v") > 5).first()
    assert p.mean_score == pytest.approx(24 / 5)
    assert aggregates.group_profile(df.withColumn("g", F.lit(1)), "g", "v", "v", F.col("v") > 5, null_as_zero=False).first().mean_score == pytest.approx(6)
    assert [r[0] for r in df.select(scalar.half_even(F.lit(2.5)), F.lit(1)).limit(1).collect()] == [2.0]


def test_selection_codec_and_predicates(spark):
    s = selection.Selection.parse("line:a:b")
    assert (s.kind, s.value, s.encode()) == ("line", "a:b", "line:a:b") and selection.Selection.parse("") is None
    kinds = selection.Kinds({"line": "l"}, {"bad": "v > 1"})
    df = spark.createDataFrame([("a:b", 2), ("x", 0), (None, None)], "l string, v long")
    count = lambda raw: df.where(kinds.predicate(selection.Selection.parse(raw))).count()
    assert [count(x) for x in ("line:a:b", "bad", "other:1", None)] == [1, 1, 0, 3]
    assert kinds.expression(s) == {"op": "=", "column": "l", "value": "a:b"}
    assert tuple(df.select(*scalar.split_once(F.lit("k:v:w"), ":")).first()) == ("k", "v:w")


def test_one_to_one_is_checked(spark):
    a, twice = spark.createDataFrame([(1,), (2,), (None,)], "k long"), spark.createDataFrame([(1, 1), (1, 2)], "k long, v long")
    with pytest.raises(relational.KeyError1to1):
        relational.one_to_one_left(a, twice, "k")
    assert relational.one_to_one_left(a, twice.limit(1), "k").count() == 3
    relational.check_contained(a.where("k = 1"), a, "k")
    with pytest.raises(ValueError):
        relational.check_contained(a.where("k = 2"), twice, "k")


def test_pages_and_order(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5) for i in range(11)], "k long, v long")
    for down in (False, True):
        rows, n, pages = relational.page(df, [relational.nulls_last("v", down), F.asc("k")], 4, 9)
        assert (n, pages) == (3, 3) and [r.v for r in rows.collect()] == [None] * 3
    assert [r.position for r in relational.numbered(df, [F.asc("k")]).orderBy("k").collect()] == list(range(1, 12))
    assert relational.seeded_sample(df, "k", 5, 3).count() == 5
    assert relational.page(df.limit(0), [F.asc("k")], 4, 2)[1:] == (1, 1)


def _pixels(spark, a):
    return spark.createDataFrame([(int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(a) if not np.isnan(v)], "row int, col int, value double")


def test_grid_neighbourhoods(spark):
    r = np.random.default_rng(0)
    a = r.integers(0, 50, (9, 11)).astype(float)
    a[r.random(a.shape) < 0.2] = np.nan
    df = _pixels(spark, a)

    def around(b, i, j, k, f):
        return f(b[max(0, i - k) : i + k + 1, max(0, j - k) : j + k + 1])

    top = {(x.row, x.col): x.extreme for x in grid.local_extreme(df, "value", 1).collect()}
    assert all(top[i, j] == around(a, i, j, 1, np.nanmax) for (i, j), v in np.ndenumerate(a) if not np.isnan(v))
    hat = grid.black_top_hat(df, "value", 1, cap=0.9).collect()
    assert all(x.top_hat >= 0 for x in hat)
    assert {(x.row, x.col) for x in grid.opening(df, "value", 1).where("opened > value").collect()} == set()
    means = {(x.row, x.col): (x.value, x.n) for x in grid.block_average(df, 3, ["value"], 0.5).collect()}
    for (i, j), (v, n) in means.items():
        part = a[3 * i : 3 * i + 3, 3 * j : 3 * j + 3]
        assert n == (~np.isnan(part)).sum() and (v is None) == (n < 4.5) and (v is None or v == pytest.approx(np.nanmean(part)))
    alpha = grid.alpha_average(df.withColumn("alpha", F.lit(0.5)), 3, ["value"], "alpha").collect()
    assert all(x.alpha <= 0.5 for x in alpha)
    moved = grid.warp(df, df.select("row", "col", (F.col("row") + 0.0).alias("y"), (F.col("col") + 0.0).alias("x")), "value")
    assert moved.join(df, ["row", "col", "value"]).count() == df.count()


def test_components_join_diagonals(spark):
    r = np.random.default_rng(1)
    a = np.where(r.random((20, 20)) < 0.35, 1.0, np.nan)
    got = {(x.row, x.col): x.component for x in grid.components(_pixels(spark, a)).collect()}
    seen: dict = {}
    for p in got:
        if p in seen:
            continue
        todo, own = [p], []
        seen[p] = p
        while todo:
            i, j = todo.pop()
            own.append((i, j))
            for q in ((i + b, j + c) for b in (-1, 0, 1) for c in (-1, 0, 1)):
                if q in got and q not in seen:
                    seen[q] = p
                    todo.append(q)
        assert len({got[q] for q in own}) == 1
    assert len(set(got.values())) == len(set(seen.values()))
    square = spark.createDataFrame([(1, i, j) for i in range(4) for j in range(2)], "component long, row int, col int")
    assert grid.shape(square, "component").first()[:] == (1, 8, pytest.approx(1.0), pytest.approx(2.0))


def test_phase_shift_and_angle(spark):
    r = np.random.default_rng(2)
    a = r.random((16, 16))
    tiles = spark.createDataFrame([(1, a.ravel().tolist(), np.roll(a, (2, -3), (0, 1)).ravel().tolist())], "k long, a array<double>, b array<double>")
    got = grid.phase_shifts(tiles, "k", 16).first()
    assert (got.dy, got.dx) == (2, -3) and got.response > 0.5
    stripes = _pixels(spark, np.fromfunction(lambda i, j: (j % 4 < 2) * 1.0, (24, 24)))
    assert grid.dominant_angle(stripes, "value", [0, 30, 60, 90]).first().angle == 0


def test_orientation_is_found_to_a_twentieth_of_a_degree(spark):
    y, x = np.mgrid[0:200, 0:200].astype(float)
    for turn in (0.0, 33.35, 121.8):
        t = math.radians(turn)
        values = np.cos(2 * np.pi * (x * math.cos(t) + y * math.sin(t)) / 9.0)
        got = grid.orientation(_pixels(spark, values).repartition(5), "value").collect()
        assert len(got) == 1 and min(abs(got[0].angle - turn), 180 - abs(got[0].angle - turn)) <= 0.1
    assert grid.orientation(_pixels(spark, y).where("false"), "value").count() == 0


def test_angle_profiles_equal_the_plain_sum(spark):
    r = np.random.default_rng(3)
    values = r.random((20, 30))
    df = _pixels(spark, values).unionByName(spark.createDataFrame([(0, 0, None), (1, 1, float("nan"))], "row int, col int, value double")).repartition(7)
    y, x = np.mgrid[0:20, 0:30].astype(float)
    for row in grid.angle_profiles(df, "value", [0, 30, 77.5, 90], 2.0).collect():
        t = math.radians(row.angle)
        bins = np.floor((x * math.cos(t) + y * math.sin(t)) / 2.0 + 1e-9)
        means = np.array([values[bins == b].mean() for b in bins.ravel()])
        assert row.bins == len(np.unique(bins)) and math.isclose(row.variance, np.var(means), rel_tol=1e-9)


def test_crops_and_windows(spark):
    df = grid.tiled(_pixels(spark, np.arange(64.0).reshape(8, 8)), 4)
    got = grid.crop(spark.createDataFrame([(1, 4, 4), (2, 0, 0)], "k long, row int, col int"), df, "k", 4, 4)
    assert got.where("k = 1").count() == 16 and got.where("k = 2").count() == 4
    assert grid.window(df, 2, 2, 3, 3, 4).count() == 9
    assert df.select(grid.no_data("value", 3.0, 0.0, 60.0).alias("v")).where("v IS NULL").count() == 4


def test_folds_keep_groups_together(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(70)], "k long, g long")
    got = ml.folds(df, F.col("g"), 3).collect()
    assert len(got) == 70 and all(len({r.fold for r in got if r.g == g}) == 1 for g in range(7)) and {r.fold for r in got} == {0, 1, 2}


def test_greedy_folds_equal_the_greedy_rule(spark):
    r = random.Random(1)
    for _ in range(300):
        k, sizes = r.randint(1, 6), sorted((r.choice([1, 1, 1, 2, 3, 5, 8, 40]) for _ in range(r.randint(1, 60))), reverse=True)
        if r.random() < 0.3:
            sizes.insert(0, 500)
        rows, want = [0] * k, []
        for n in sizes:
            f = min(range(k), key=lambda f: (rows[f], f))
            rows[f] += n
            want.append(f)
        held, got = [0] * k, []
        for n in sorted(set(sizes), reverse=True):
            turns = ml._turns(held, n, sizes.count(n))
            for i in range(sizes.count(n)):
                at, order = [t for t in turns if t[0] <= i][-1]
                got.append(order[(i - at) % len(order)])
            assert len(turns) <= k
        assert got == want and held == rows
    # A group with a third of all rows; a null group is a group.
    df = spark.createDataFrame([(i, 7 if i < 400 else None if i < 410 else 1000 + i) for i in range(1200)], "k long, g long")
    got = ml.greedy_folds(df, F.col("g"), 3).groupBy("fold").count().collect()
    assert sorted(x["count"] for x in got) == [400, 400, 400]
    assert ml.greedy_folds(df.limit(0), F.col("g"), 3).count() == 0


def test_sparse_extents_fill_at_once(spark):
    far = [(0, 0), (0, 10**6), (10**6, 0), (5, 5), (5, 7), (4, 6), (6, 6), (4, 5), (4, 7), (6, 5), (6, 7)]
    got = {(p.row, p.col) for p in grid.fill_holes(spark.createDataFrame(far, "row int, col int")).collect()}
    assert got == set(far) | {(5, 6)}
    r = random.Random(4)
    for seed in range(3):
        cells = {(r.randrange(14), r.randrange(14)) for _ in range(120)}
        free = {(y, x) for y in range(-1, 15) for x in range(-1, 15)} - cells
        open_ = [(-1, -1)]
        seen = set(open_)
        while open_:
            y, x = open_.pop()
            for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if q in free and q not in seen:
                    seen.add(q)
                    open_.append(q)
        got = {(p.row, p.col) for p in grid.fill_holes(spark.createDataFrame(list(cells), "row int, col int")).collect()}
        assert got == cells | (free - seen)


def test_large_groups_are_ranked(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "FEW_VALUES", 50)
    df = spark.createDataFrame([(i % 7 if i < 200 else 9, float(i * 37 % 101) if i % 11 else None) for i in range(900)], "k long, v double")
    got = {x.k: x for x in aggregates.quantiles(df, "v", [0.1, 0.5], ["k"]).collect()}
    rows = df.where("v IS NOT NULL").collect()
    for k in {x.k for x in rows}:
        own = [x.v for x in rows if x.k == k]
        assert got[k].n == len(own) and got[k].q == pytest.approx(list(np.quantile(own, [0.1, 0.5])))
    assert aggregates.quantiles(df, "v", [0.5]).first().q == [np.median([x.v for x in rows])]


def test_large_groups_are_not_joined_by_their_keys(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "FEW_VALUES", 50)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(400).select((F.col("id") % 7 > 4).cast("int").alias("k"), (F.col("id") * 37 % 101).cast("double").alias("v"))
        got = aggregates.quantiles(df, "v", [0.5], ["k"])
        # A sort by the key would hold a whole group in one task.
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r.k: (r.n, r.q[0]) for r in got.collect()} == {k: (len(own), np.median(own)) for k in (0, 1) if (own := [float(i * 37 % 101) for i in range(400) if int(i % 7 > 4) == k])}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def walked(rows, tolerance, max_lag):
    """Tracks of (id, block, position), by one walk over all blocks."""
    last, out = [], {}
    for b in sorted({b for _, b, _ in rows}):
        part = sorted((x, i) for i, own, x in rows if own == b)
        pairs = sorted((abs(x - p), t, x, i) for x, i in part for t, (seen, p) in enumerate(last) if b - seen <= max_lag and abs(x - p) <= tolerance)
        used = set()
        for _, t, _, i in pairs:
            if t not in used and i not in out:
                used.add(t)
                out[i] = t
        for x, i in part:
            if i not in out:
                out[i] = len(last)
                last.append((b, x))
            else:
                last[out[i]] = (b, x)
    return out


@pytest.mark.parametrize(("tolerance", "max_lag", "width"), [(1.0, 2, 200), (2.5, 1, 60), (0.0, 3, 30), (3.0, 4, 40)])
def test_tracks_equal_one_walk(spark, tolerance, max_lag, width):
    r = random.Random(width)
    rows = {(r.choice([b for b in range(40) if b % 9 < 5]), round(r.uniform(0, width), 1 if tolerance else 0)) for _ in range(250)}
    rows = [(i, b, x) for i, (b, x) in enumerate(sorted(rows, key=lambda _: r.random()))]
    df = spark.createDataFrame([*rows, (900, None, 1.0), (901, 3, None)], "k long, block long, at double").withColumn("track", F.lit("clash")).repartition(4)
    got = {x.k: x.track for x in sequence.link_tracks(df, "block", "at", tolerance, max_lag).collect()}
    assert got == {**walked(rows, tolerance, max_lag), 900: None, 901: None}


def test_stretches_take_one_sort(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(relational, "cut", lambda df, name: stored.append(name) or cut(df, name))
    r = random.Random(5)
    rows = sorted((r.randrange(4), r.choice([float("inf"), float("-inf"), round(r.uniform(0, 40), 1)] if r.random() < 0.1 else [round(r.uniform(0, 40), 1)])) for _ in range(300))
    expected, number = {}, -1
    for (k0, v0), (k, v) in zip([(None, None), *rows], rows):
        number += k0 != k or v0 != v and v - v0 > 0.7
        expected[k, v] = number
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id long, k long, v double").repartition(5)
    got = relational.split_by_gaps(df, "v", 0.7, "n", ["k"]).collect()
    assert len(stored) == 1 and len(got) == 300 and number > 8
    assert {(x.k, x.v): x.n for x in got} == expected


def test_track_query(spark):
    from fieldloom import catalog_objects

    sf = "/root/testdata/sf0.001"
    rows = [((p.block, p["at"]), p.block, p["at"]) for p in catalog_objects._weekly(spark, sf).collect()]
    got = {(x.block, x["at"]): x.track for x in catalog_objects.track_links(spark, sf).collect()}
    assert got == walked(rows, 0.15, 4) and len(set(got.values())) < len(got) / 2


def test_classifier_and_mixture(spark):
    r = np.random.default_rng(3)
    rows = [(i, i % 2, float(r.normal(3 * (i % 2))), float(r.normal()), i % 5) for i in range(200)]
    df = ml.vectors(spark.createDataFrame(rows, "k long, y int, a double, b double, g long"), ["a", "b"])
    oof = ml.out_of_fold(ml.folds(df, F.col("g"), 2), "y", 2)
    assert aggregates.auc(oof, "p", F.col("y") == 1).first().auc > 0.9
    model, k, bic = ml.fit_mixture(df.select("k", "features"), [2, 3, 150], least_rows=10)
    assert set(bic) == {2, 3} and k == min(bic, key=bic.get)
    post = ml.posterior_stats(model.transform(df), list(range(k))).collect()
    assert all(0 <= x.group < k and 0 < x.group_p <= 1 for x in post)
    with pytest.raises(ValueError):
        ml.require_rows(df, 1000)
    one = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    assert [round(x[0], 6) for x in one.select(ml.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]
    assert ml.project(df, 1).count() == 200


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', 1.5, 10.0, 20.0), (2, None, float("nan"), 11.0, 21.0)], "id long, name string, v double, x double, y double")
    folder = str(tmp_path / "g")
    files.write_feature_lines(files.point_features(df, "x", "y", ["name", "v", "missing", "id"]), folder)
    back = files.read_feature_lines(spark, folder, "id long, name string, v double").orderBy("id").collect()
    assert [(r.id, r.name, r.v) for r in back] == [(1, 'a,"b"', 1.5), (2, None, None)]
    whole = tmp_path / "w.json"
    whole.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": 7, "name": "n"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}}]}))
    got = files.read_geojson(spark, str(whole), "id long, name string").select("id", geometry.area(files.ring_of()).alias("a")).first()
    assert (got.id, got.a) == (7, 2.0)
    files.write_csv(df, str(tmp_path / "c"), ["id", "name", "v"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "c")).collect()) == ['1,"a,""b""",1.5', "2,,NaN"]
    assert files.discover(spark, str(tmp_path), {"w": r"w\.json"})["w"].endswith("w.json")
    with pytest.raises(ValueError):
        files.discover(spark, str(tmp_path), {"w": "nothing"})
    assert files.read_optional(spark, str(tmp_path / "none"), "a long").count() == 0
    key = files.fingerprint(df, ["id", "name"])
    assert key == files.fingerprint(df.repartition(3), ["id", "name"]) != files.fingerprint(df.limit(1), ["id", "name"])
    calls = []
    for _ in range(2):
        assert files.cached(spark, str(tmp_path), key, lambda: calls.append(1) or df.select("id")).count() == 2
    assert len(calls) == 1
    assert json.loads(files.document(df.where("id = 1")).first().value)["id"] == 1


def test_runner_and_jobs(spark, tmp_path):
    stages = [("a", lambda s, t: s.range(3)), ("b", lambda s, t: t["a"].where("id > 0")), ("c", lambda s, t: t["b"].where("id > 1"))]
    run = Runner(stages, str(tmp_path))
    assert {k: v.count() for k, v in run.run(spark).items()} == {"a": 3, "b": 2, "c": 1}
    assert run.chosen(start="b", skip=["c"]) == ["b"] and Runner(stages, str(tmp_path)).run(spark, start="c")["c"].count() == 1
    with pytest.raises(ValueError):
        run.chosen(start="z")
    jobs = spark.createDataFrame([("j1", "queued", 3.0, None), ("j2", "running", 1.0, None), ("j3", "queued", 2.0, None)], "id string, status string, created double, error string")
    assert tuple(queue_status(jobs).first()) == (2, 1)
    assert {r.id: r.place for r in queue_positions(jobs).collect()} == {"j3": 1, "j1": 2}
    assert {r.status for r in recover(jobs).collect()} == {"failed"} and newest_first(jobs).first().id == "j1"
    steps = spark.createDataFrame([(1, "fly", True), (2, "plant", False), (3, "grow", False)], "pos int, step string, done boolean")
    assert tuple(aggregates.timeline(steps).first()) == ("fly", "plant", False)
    w = spark.createDataFrame([("a", 1), ("b", 3)], "stage string, weight int")
    assert aggregates.progress(spark.createDataFrame([("a", True)], "stage string, done boolean"), w).first().progress == 0.25
    line = spark.createDataFrame([("[2/7] align",), ("align done in 12.5 s",)], "line string").select(*(c.alias(k) for k, c in scalar.log_fields("line").items())).collect()
    assert [tuple(x) for x in line] == [(2, "align", None), (None, "align", 12.5)]


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(4).write.parquet(str(tmp_path / "in"))
    query = events.tumbling(events.read_events(spark, str(tmp_path / "in"), 1), "1 day", "365 days").writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = events.tumbling(source.withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "365 days")
    assert sorted(map(str, spark.table("tumbled").collect())) == sorted(map(str, batch.collect())) or spark.table("tumbled").count() == batch.count()


def test_formats(spark):
    one = spark.range(1)
    got = one.select(scalar.fmt_int(F.lit(1234567.4)), scalar.fmt_fixed(F.lit(-1.256)), scalar.fmt_fixed(F.lit(1.2), 1, True), scalar.fmt_percent(F.lit(0.1234)), scalar.fmt_percent(F.lit(None).cast("double")), scalar.day_of(F.lit(86400)), scalar.weak_label(F.lit(True), F.lit(True)), scalar.tile_resolution(0), scalar.equivalent_diameter(F.lit(math.pi))).first()
    assert tuple(got)[:7] == ("1,234,567", "-1.26", "+1.2", "12.3%", "-", "1970-01-02", -1)
    assert got[7] == pytest.approx(156543.0339) and got[8] == pytest.approx(2.0)
    x, y = scalar.affine(0.5, 0, 100, 0, -0.5, 200, F.lit(3), F.lit(4))
    c, r = scalar.affine_inverse(0.5, 0, 100, 0, -0.5, 200, x, y)
    assert tuple(one.select(c, r).first()) == (3, 4)
    e = aggregates.match_quality(F.lit(10), F.lit(8), F.lit(6))
    assert tuple(one.select(e["precision"], e["recall"]).first()) == (0.6, 0.75)


def test_evaluation_in_two_passes(spark):
    reference = spark.createDataFrame([(i, 10.0 * i, 0.0) for i in range(8)], "r long, x double, y double")
    found = spark.createDataFrame([(i, 10.0 * i + 3.0, 1.0) for i in range(6)] + [(9, 500.0, 0.0)], "f long, x double, y double")
    one = spatial.evaluate(found, reference, "f", "r", 4.0).first()
    assert (one.n_matched, one.precision, one.recall) == (6, 6 / 7, 6 / 8) and (one.offset_x, one.offset_y) == (3.0, 1.0)
    two = spatial.evaluate_shifted(found, reference, "f", "r", 4.0).first()
    assert two.n_matched == 6 and two.median_distance == 0.0


def test_stability_of_clear_groups(spark):
    r = np.random.default_rng(5)
    rows = [(i, i % 2, [float(r.normal(20 * (i % 2))), float(r.normal())]) for i in range(120)]
    df = ml.vectors(spark.createDataFrame(rows, "k long, g int, v array<double>"), ["v"])
    got = ml.stability(df, "k", "g", 2, runs=2).collect()
    assert [x.run for x in got] == [0, 1] and all(x.adjusted_rand > 0.95 for x in got)


def test_cosine_search_in_blocks_of_queries(spark):
    r = random.Random(11)
    rows = [(i, [float(r.randrange(-2, 3)) for _ in range(3)] if i % 17 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(5)

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)) if a and b else 0
        return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else -2.0

    want = [(q, k, n + 1) for q, v in rows if q % 5 == 0 for n, (_, k) in enumerate(sorted((-cosine(w, v), k) for k, w in rows if k != q)[:4])]
    for most in (10_000, 7):
        got = ml.cosine_top(df, df.where("vec_id % 5 = 0"), "vec_id", "v", 4, max_queries=most).collect()
        assert sorted((x.query, x.vec_id, x["rank"]) for x in got) == sorted(want)
    assert ml.cosine_top(df, df.limit(0), "vec_id", "v", 4).count() == 0


def test_cosine_search_takes_every_fiftieth_row(spark):
    from fieldloom import catalog

    got = catalog.queries()["cosine_topk_all"](spark, "/root/testdata/sf0.1")
    assert got.count() == 200 and sorted(x[0] for x in got.select("query").distinct().collect()) == list(range(0, 2000, 50))


def test_interpolation_in_blocks_of_controls(spark):
    r = random.Random(12)
    controls = [(float(r.randrange(20)), float(r.randrange(20)), float(r.randrange(-9, 9))) for _ in range(60)] + [(3.0, 4.0, 5.0)] * 8
    targets = [(i, j) for i in range(6) for j in range(7)]
    c, t = spark.createDataFrame(controls, "row double, col double, v double"), spark.createDataFrame(targets, "row int, col int")

    def at(row, col):
        w = [1 / (math.hypot(row - a, col - b) ** 2 + 1e-12) for a, b, _ in controls]
        return sum(x * v for x, (_, _, v) in zip(w, controls, strict=True)) / sum(w)

    for most in (10_000, 9):
        got = {(x.row, x.col): x.v for x in grid.idw(t, c, "v", max_controls=most).collect()}
        assert got == {k: pytest.approx(at(*k)) for k in targets}


def test_interpolated_field_has_every_pixel_from_every_supplier(spark):
    from fieldloom import catalog

    got = catalog.queries()["interpolated_field_all"](spark, "/root/testdata/sf0.01")
    pixels = catalog._pixels(spark, "/root/testdata/sf0.01")
    assert got.count() == pixels.count() and pixels.join(got, ["row", "col"], "left_anti").isEmpty()
    x, controls = got.first(), spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").collect()
    w = [1 / (math.hypot(x.row - c.s_suppkey * 7 % 64, x.col - c.s_suppkey * 11 % 64) ** 2 + 1e-12) for c in controls]
    assert x["shift"] == pytest.approx(sum(a * c.s_acctbal for a, c in zip(w, controls, strict=True)) / sum(w), abs=1e-5)


def test_all_suppliers_are_zones(spark):
    from fieldloom import catalog

    sf = "/root/testdata/sf0.01"
    keys = [x[0] for x in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect()]
    boxes = sorted((k, k * 13 % 60, k * 29 % 60) for k in keys)
    pixels = {(x.row, x.col): float(x.value) for x in catalog._pixels(spark, sf).collect()}
    owner = {p: next((k for k, x, y in boxes if x <= p[1] < x + 9 and y <= p[0] < y + 7), None) for p in pixels}
    got = {x.zone: x.n for x in catalog.queries()["zonal_stats_all"](spark, sf).collect()}
    assert got == {k: n for k in keys if (n := sum(o == k for o in owner.values()))} and max(got) > 40
    want = {k: n for k, x, y in boxes if (n := sum(o is None and 6 < math.hypot(x + 4 - c, y + 3 - r) <= 12 for (r, c), o in owner.items()))}
    got = {x.zone: x.n_pixels for x in catalog.queries()["ring_background_all"](spark, sf).collect()}
    assert got == want and max(got) > 40


def test_chain_looks_at_all_earlier_rows(spark):
    r = random.Random(13)
    dense = [(1, i * 0.25, r.uniform(-0.5, 0.5)) for i in range(400)]
    gap = [(2, 0.0, 9.0), *((2, 1.0 + i * 0.01, -1.0) for i in range(300)), (2, 10.0, 1.0)]
    tied = [(3, float(i // 40), r.choice([-0.5, 0.5])) for i in range(400)]
    rows = dense + gap + tied
    got = sequence.chain_select(spark.createDataFrame(rows, "line long, x double, s double"), "line", "x", "s", 10.0, 2.0).collect()

    def chain(own):
        total, back = [t[2] for t in own], [-1] * len(own)
        for i in range(1, len(own)):
            steps = [(own[i][1] - own[j][1]) / 10.0 for j in range(i)]
            values = [total[j] - 2.0 * (q - max(1, round(q))) ** 2 for j, q in enumerate(steps)]
            j = values.index(max(values))
            if values[j] > 0:
                total[i], back[i] = own[i][2] + values[j], j
        i, out = total.index(max(total)), []
        while i >= 0:
            out.append(own[i])
            i = back[i]
        return out[::-1]

    for part in (dense, gap, tied):
        assert sorted(tuple(t) for t in got if t.line == part[0][0]) == sorted(chain(part))
    assert [t[1] for t in chain(gap)] == [0.0, 10.0]


def test_nearest_over_a_wide_extent(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 9e5, 0.0), (3, float("nan"), 0.0), (4, None, 0.0)], "i long, x double, y double")
    b = spark.createDataFrame([(7, 1e6, 0.0), (8, 0.0, 3e5), (9, float("inf"), 0.0)], "j long, x double, y double")
    got = sorted(tuple(t) for t in spatial.nearest(a, b, "i", "j", 1.0).collect())
    assert got == [(1, 8, 3e5), (2, 7, 1e5)]
    assert spatial.nearest(a, b.limit(0), "i", "j", 1.0).count() == 0


def test_dense_cells_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "FEW_PAIRS", 100)
    monkeypatch.setattr(spatial, "BLOCK", 7)
    df = spark.range(60).select("id", (F.col("id") * 0.01).alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") * 0.01 + 1).alias("x1"), F.lit(1.0).alias("y1")).coalesce(1)
    pairs = spatial.box_overlaps(df, "id", 50.0)
    assert {(x.k, x.o_k) for x in pairs.collect()} == {(i, j) for i in range(60) for j in range(i + 1, 60)} and pairs.count() == 60 * 59 // 2
    spread = spatial.box_overlaps(df, "id", 50.0).select(F.spark_partition_id().alias("t")).distinct().count()
    assert spread > 1
    points = df.select("id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    near = spatial.radius_join(points, points, 0.1051)
    assert near.count() == sum(abs(i - j) <= 10 for i in range(60) for j in range(60))
    assert near.select(F.spark_partition_id().alias("t")).distinct().count() > 1


def test_dense_tables_need_few_pairs(spark, monkeypatch):
    """Searches for one row each list a few pairs for each row, not all that lie within the radius."""
    made, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda *args: made.append(join(*args)) or made[-1])
    monkeypatch.setattr(spatial, "FEW_PAIRS", 0)
    points = lambda n, step: spark.range(n).select("id", (F.col("id") * step % 1009 / 100.0).alias("x"), (F.col("id") * (step + 400) % 1013 / 100.0).alias("y"))
    a, b = points(300, 389).withColumnRenamed("id", "i"), points(150, 211).withColumnRenamed("id", "j")
    dist = {(p.i, q.j): math.hypot(p.x - q.x, p.y - q.y) for p in a.collect() for q in b.collect()}
    got = {p.i: (round(p.distance, 9), p.j) for p in spatial.nearest(a, b, "i", "j", 20.0).collect()}
    assert got == {i: min((round(dist[i, j], 9), j) for j in range(150)) for i in range(300)}
    used, left, want = set(), set(), set()
    for (i, j), d in sorted(dist.items(), key=lambda e: (e[1], e[0])):
        if d <= 4 and i not in used and j not in left:
            used.add(i)
            left.add(j)
            want.add((i, j))
    assert {(p.i, p.j) for p in spatial.greedy_match(a, b, "i", "j", 4.0).collect()} == want
    assert made[0].count() <= spatial.PAIRS_A_ROW * 450


def test_suppression_in_parts_equals_sequential(spark, monkeypatch):
    monkeypatch.setattr(spatial, "FIRST_PART", 10)
    box = [(k, k * 389 % 101 / 10.0, k * 211 % 103 / 10.0, k * 7 % 5) for k in range(150)]
    df = spark.createDataFrame(box, "k0 long, x0 double, y0 double, p long").withColumns({"x1": F.col("x0") + 2, "y1": F.col("y0") + 2})
    compared = []

    def conflicts(a, other):
        compared.append((a.count(), None if other is None else other.count()))
        return spatial.box_overlaps(a, "k0", 4.0, other).where("ratio > 0.25")

    kept = []
    for b in sorted(box, key=lambda b: (-b[3], b[0])):
        if not any((2 - abs(b[1] - c[1])) * (2 - abs(b[2] - c[2])) > 1.0 and abs(b[1] - c[1]) < 2 and abs(b[2] - c[2]) < 2 for c in kept):
            kept.append(b)
    assert sorted(x.k0 for x in spatial.suppress_dense(df, "k0", "p", conflicts).collect()) == sorted(b[0] for b in kept)
    assert max(n for n, other in compared if other is None) < 60
