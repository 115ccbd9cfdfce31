"""Polygons and per-object features against brute force; grids, files and lines that used to lose or merge rows."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom import catalog_objects
from fieldloom.operators import aggregates, grid, ml, polygons, relational, spatial
from fieldloom.sources import files

CONCAVE = np.array([(0, 0), (10, 0), (10, 10), (6, 10), (6, 3), (4, 3), (4, 10), (0, 10)], dtype=float)


def star(r, x, y, n, size):
    angles = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
    return np.array([(x + size * r.uniform(0.3, 1) * math.cos(a), y + size * r.uniform(0.3, 1) * math.sin(a)) for a in angles])


def inside(ring, x, y):
    odd = np.zeros(len(x), dtype=bool)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0)):
        if ay != by:
            odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd


def test_overlap_area_against_many_points():
    r = random.Random(3)
    at = np.random.default_rng(0).uniform(-2, 12, (200_000, 2))
    for _ in range(8):
        a, b = star(r, r.uniform(2, 8), r.uniform(2, 8), r.randint(3, 9), 5), r.choice([CONCAVE, star(r, 5, 5, 5, 4)])
        share = (inside(a, *at.T) & inside(b, *at.T)).mean() * 14 * 14
        assert polygons.overlap_area(a, b) == pytest.approx(share, abs=0.35)
    assert polygons.overlap_area(CONCAVE, CONCAVE) == pytest.approx(abs(polygons.signed_area(CONCAVE)))
    notch = np.array([(4.5, 5), (5.5, 5), (5.5, 9), (4.5, 9)], dtype=float)
    assert polygons.overlap_area(CONCAVE, notch) == 0 and not polygons.meet(CONCAVE, notch)
    assert polygons.meet(CONCAVE, notch + (1.5, 0)) and polygons.meet(CONCAVE, CONCAVE + (10, 0)) and not polygons.meet(CONCAVE, CONCAVE + (10.1, 0))
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], dtype=float)
    assert abs(polygons.signed_area(polygons.clip(CONCAVE, square))) == pytest.approx(polygons.overlap_area(CONCAVE, square))


def frame(spark, rings):
    return spark.createDataFrame([(i, [tuple(p) for p in ring.tolist()] if ring is not None else None) for i, ring in rings], f"k long, ring {polygons.RING}")


def test_joins_of_polygons(spark):
    r = random.Random(5)
    rings = [(i, star(r, r.uniform(0, 60), r.uniform(0, 60), r.randint(3, 8), 6)) for i in range(60)] + [(98, None), (99, CONCAVE[:2])]
    df = frame(spark, rings)
    real = [x for x in rings if x[0] < 98]
    want = {(i, j): polygons.overlap_area(a, b) / min(abs(polygons.signed_area(a)), abs(polygons.signed_area(b))) for i, a in real for j, b in real if i < j}
    got = {(x.k, x.o_k): x.ratio for x in polygons.polygon_overlaps(df, "k", "ring", 9.0).collect()}
    assert got == pytest.approx({p: v for p, v in want.items() if v > 0})
    other = frame(spark, [(i + 100, ring + (3, 3)) for i, ring in real[:20]]).withColumnRenamed("k", "o")
    pairs = {(x.k, x.o) for x in polygons.polygons_meeting(df, other, "k", "o", "ring", 9.0).collect()}
    assert pairs == {(i, j + 100) for i, a in real for j, b in real[:20] if polygons.meet(a, b + (3, 3))}
    assert polygons.meets_any(df, other, "k", "o", "ring", 9.0).where("meets").count() == len({i for i, _ in pairs})
    assert polygons.polygon_overlaps(df.limit(0), "k", "ring", 9.0).count() == 0


def test_polygon_suppression_equals_the_sequential_one(spark):
    sf = "/root/testdata/sf0.001"
    rows = catalog_objects._rings(spark, sf)
    edges = polygons.polygon_overlaps(rows, "c", "ring", 40.0).where("ratio > 0.3").collect()
    near = {}
    for e in edges:
        near.setdefault(e.k, set()).add(e.o_k)
        near.setdefault(e.o_k, set()).add(e.k)
    kept = set()
    for x in sorted(rows.collect(), key=lambda x: (-x.priority, x.c)):
        if not near.get(x.c, set()) & kept:
            kept.add(x.c)
    assert {x.c for x in catalog_objects.polygon_suppression(spark, sf).collect()} == kept


def test_zones_and_rings(spark):
    pixels = spark.createDataFrame([(y, x) for y in range(12) for x in range(12)], "row int, col int")
    zones = frame(spark, [(2, CONCAVE), (1, CONCAVE + (0, 5))])
    got = {(p.row, p.col): p.k for p in polygons.zone_owner(pixels, zones, "k", "ring", 4.0).collect()}
    x, y = (g.ravel() + 0.5 for g in np.meshgrid(range(12), range(12)))
    one, two = inside(CONCAVE + (0, 5), x, y), inside(CONCAVE, x, y)
    assert got == {(int(b), int(a)): 1 if o else 2 for a, b, o, t in zip(x, y, one, two) if o or t}
    only = polygons.zone_owner(pixels, zones, "k", "ring", 4.0, only=True)
    assert only.count() == (one ^ two).sum()
    mine = polygons.zone_owner(pixels, frame(spark, [(2, CONCAVE)]), "k", "ring", 4.0)
    (row,) = polygons.component_rings(mine, "k").collect()
    assert row.area == 86 and {(p.x, p.y) for p in row.ring} == {tuple(p) for p in CONCAVE}
    (part,) = polygons.component_rings(spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 3, 1), (1, 3, 2), (1, 3, 3), (1, 2, 3), (1, 1, 3)], "k int, row int, col int"), "k").collect()
    assert part.area == 9  # the larger part, its hole filled


def test_simplify(spark):
    r = random.Random(2)
    line = np.array([(i, math.sin(i / 5) * 4 + r.uniform(-0.1, 0.1)) for i in range(80)])
    short = polygons.simplify(line, 0.3)
    assert 2 < len(short) < 40
    for p in line:
        d = min(abs((b - a)[0] * (p - a)[1] - (b - a)[1] * (p - a)[0]) / np.hypot(*(b - a)) for a, b in zip(short, short[1:]) if a[0] <= p[0] <= b[0])
        assert d <= 0.3 + 1e-9
    dense = np.concatenate([np.linspace(a, b, 9)[:-1] for a, b in zip(CONCAVE, np.roll(CONCAVE, -1, axis=0))])
    assert {tuple(p) for p in polygons.simplify_ring(dense, 0.01)} == {tuple(p) for p in CONCAVE}
    df = frame(spark, [(1, dense), (2, None)])
    assert {x.k: x.n for x in df.select("k", F.size(polygons.simplified("ring", 0.01)).alias("n")).collect()} == {1: 8, 2: None}


def test_features_of_objects(spark):
    pixels = spark.createDataFrame([(y, x, float(y), 0.0, 200.0, 0.0) for y in range(4) for x in range(4)], "row int, col int, v double, r double, g double, b double")
    zones = frame(spark, [(1, np.array([(0, 0), (2, 0), (2, 4), (0, 4)], dtype=float)), (2, CONCAVE + (90, 0))])
    a, b = polygons.object_features(pixels, zones, "k", "ring", 5.0, "v", ("r", "g", "b")).orderBy("k").collect()
    assert (a.area, a.perimeter, a.n_pixels, a.p50, a.green_fraction, a.exg) == (8, 12, 8, 1.5, 1.0, 2.0) and b.n_pixels is None and b.area == 86


def test_quantiles_equal_numpy(spark):
    r = np.random.default_rng(1)
    rows = [(int(k), None if v > 9 else float(round(v, 1))) for k, v in zip(r.integers(0, 4, 500), r.uniform(0, 10, 500))] + [(None, 1.0), (7, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    at = [0.0, 0.13, 0.5, 0.9, 1.0]
    got = {x.k: x for x in aggregates.quantiles(df, "v", at, ["k"]).collect()}
    for k in (0, 1, 2, 3, None):
        own = [v for q, v in rows if q == k and v is not None]
        assert got[k].n == len(own) and got[k].q == pytest.approx(list(np.quantile(own, at)))
    assert 7 not in got and aggregates.percentile_profile(df, "v", ["k"]).where("k = 7").first().p50 is None
    assert aggregates.quantiles(df.limit(0), "v", [0.5]).count() == 0
    z = aggregates.robust_z(df.limit(0), "v", "z")
    assert z.count() == 0 and aggregates.impute_median(spark.createDataFrame([(None,), (None,)], "v double"), ["v"]).where("v IS NULL").count() == 2


def test_prefix_sums_and_numbers(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("k"), "id", (F.col("id") % 5).alias("w"))
    got = relational.prefix_sums(df, [F.col("k").asc(), F.col("id").asc()], ["w"]).orderBy("k", "id").collect()
    done = 0
    for x in got:
        assert x.w_before == done
        done += x.w
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    assert [x.position for x in relational.numbered(df, [F.asc("k"), F.asc("id")]).orderBy("k", "id").collect()] == list(range(1, 1001))
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_repeated_rows_stay(spark):
    points = spark.createDataFrame([(5.0, 1.0), (5.0, 1.0), (99.0, 0.0)], "x double, y double")
    lines = spark.createDataFrame([(7, [0.0, 10.0], [0.0, 0.0]), (3, [0.0, 10.0], [2.0, 2.0]), (4, [], [])], "l int, xs array<double>, ys array<double>")
    for at_once in (2000, 1):
        got = spatial.nearest_line(points, lines, "l", "x", "y", at_once=at_once).collect()
        assert sorted((p.l, p.offset) for p in got if p.l) == [(3, -1.0), (3, -1.0)] and sum(p.l is None for p in got) == 1
    controls = spark.createDataFrame([(0.0, 0.0, 4.0), (0.0, 4.0, 8.0)], "row double, col double, v double")
    targets = spark.createDataFrame([(0, 2), (0, 2), (0, 0)], "row int, col int")
    assert sorted(round(x.v, 3) for x in grid.idw(targets, controls, "v").collect()) == [4.0, 6.0, 6.0]
    source = spark.createDataFrame([(y, x, float(10 * y + x)) for y in range(4) for x in range(4)], "row int, col int, v double")
    moved = spark.createDataFrame([(0, 0, 0.5, 0.25), (0, 0, 0.5, 0.25), (0, 0, 2.0, 1.0), (1, 1, 9.0, 9.0)], "row int, col int, y double, x double")
    assert sorted(round(x.v, 6) for x in grid.warp(source, moved, "v").collect()) == [5.25, 5.25, 21.0]


def test_many_components(spark):
    pixels = spark.range(60_000).select((F.col("id") * 2).cast("int").alias("row"), F.lit(2_000_000_000).alias("col"))
    assert grid.components(pixels).select("component").distinct().count() == 60_000


def test_holes_and_windows(spark):
    picture = ["######", "#.##.#", "#.####", "######", "..#...", "###.##", "#...#.", "###.##"]
    cells = [(y, x) for y, line in enumerate(picture) for x, c in enumerate(line) if c == "#"]
    df = spark.createDataFrame(cells, "row int, col int")
    got = {(p.row, p.col) for p in grid.fill_holes(df).collect()}
    assert got == set(cells) | {(1, 1), (2, 1), (1, 4)}
    assert grid.fill_holes(df.limit(0)).count() == 0
    high = grid.black_top_hat(spark.createDataFrame([(y, x, 5.0 if (y, x) != (2, 2) else 1.0) for y in range(5) for x in range(5)], "row int, col int, v double"), "v", 1)
    assert {(p.row, p.col): p.top_hat for p in high.collect() if p.top_hat} == {(2, 2): 4.0}


def test_two_reference_guard(spark):
    r = random.Random(8)
    table = lambda n, k: [(i, r.uniform(0, 30), r.uniform(0, 30)) for i in range(k, k + n)]
    spots, objects, others = table(30, 0), table(80, 100), table(30, 0)
    a, b, c = (spark.createDataFrame(t, f"{n} long, x double, y double") for t, n in ((spots, "s"), (objects, "o"), (others, "t")))
    want = {}
    for s, x, y in spots:
        free = [(math.hypot(x - u, y - v), o) for o, u, v in objects if math.hypot(x - u, y - v) <= 4 and all(math.hypot(p - u, q - v) >= math.hypot(x - u, y - v) for _, p, q in others)]
        if free:
            want[s] = min(free)[1]
    assert {x.s: x.o for x in spatial.nearest_unless_closer(a, b, c, "s", "o", 4.0).collect()} == want


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b', float("nan")), (2, "x\ry", 1.5), (3, "NaN", None)], "k int, t string, v double")
    files.write_csv(df.coalesce(1), str(tmp_path / "csv"), ["k", "t", "v"], header=True, finite_only=True)
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text == 'k,t,v\n1,"a""b",\n2,"x\ry",1.5\n3,NaN,\n'
    rings = frame(spark, [(1, CONCAVE * 111319.49079327358)])
    (line,) = files.shape_features(rings, "Polygon", "ring", ["k"], 4, unproject=True).collect()
    found = json.loads(line.value)
    assert found["geometry"]["type"] == "Polygon" and found["geometry"]["coordinates"][0][0] == found["geometry"]["coordinates"][0][-1] == [0.0, 0.0]
    assert found["geometry"]["coordinates"][0][1] == [10.0, 0.0] and found["properties"] == {"k": 1}
    files.write_document(spark.createDataFrame([(1, {"good": 2})], "n int, by map<string, int>"), str(tmp_path / "doc"))
    assert files.read_document(spark, str(tmp_path / "doc"), "n int, by map<string, int>").first().by == {"good": 2}
    np.save(tmp_path / "grid.npy", np.zeros((3, 5, 2), dtype=np.float32))
    (tmp_path / "grid.png").write_bytes(bytes.fromhex("89504e470d0a1a0a0000000d49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + bytes([8, 6, 0, 0, 0]))
    (tmp_path / "other.txt").write_text("x")
    got = {r.path.rsplit("/", 1)[-1]: (r.kind, r.rows, r.cols, r.bands, r.type) for r in files.grid_headers(spark, str(tmp_path)).where("path LIKE '%grid%' OR path LIKE '%other%'").collect()}
    assert got == {"grid.npy": ("npy", 3, 5, 2, "<f4"), "grid.png": ("png", 480, 640, 4, "uint8"), "other.txt": (None, None, None, None, None)}


def test_scores(spark):
    rows = spark.createDataFrame([(1, 0.1), (2, 0.2)], "k int, p double")
    oof = spark.createDataFrame([(2, 0.9)], "k int, p double")
    assert {x.k: x.p for x in ml.final_scores(rows, oof, "k").collect()} == {1: 0.1, 2: 0.9}
    labelled = spark.createDataFrame([(0,), (0,), (1,), (1,), (None,)], "y int")
    assert ml.trained_or_stored(labelled, "y", 2, lambda df: "trained", "nowhere") == "trained"
    with pytest.raises(Exception):
        ml.trained_or_stored(labelled, "y", 3, lambda df: "trained", "/nowhere/model")
    blocks = ml.balance_blocks(spark.createDataFrame([([1.0, 10.0],), ([3.0, 30.0],)], "a array<double>"), {"a": "b"})
    assert np.var([x.b for x in blocks.collect()], axis=0).sum() == pytest.approx(1)
    sample = relational.seeded_sample(spark.range(100), "id", 10, 3)
    assert {x.id for x in sample.collect()} == {x.id for x in relational.seeded_sample(spark.range(100).repartition(7), "id", 10, 3).collect()}


def test_nearest_line_takes_the_slope_as_sql_does(spark):
    lines = spark.createDataFrame([(i, [0.0, 1100.0], [i * 50.0, i * 50.0 + 110.0]) for i in range(20)], "l long, xs array<double>, ys array<double>")
    at = [(k, k * 7919 % 10007 / 10.0, k * 104729 % 10009 / 10.0) for k in (320327, 868544, 1630028)]
    got = spatial.nearest_line(spark.createDataFrame(at, "k long, x double, y double"), lines, "l", "x", "y").collect()
    want = {k: min((abs(y - (i * 50 + 0.1 * x)), i) for i in range(20))[1] for k, x, y in at}
    assert {p.k: p.l for p in got} == want
