"""Overlay measures, hierarchical cells, union areas and ring zones against brute force."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import overlay, polygons
from tests.test_polygons import CONCAVE, frame, inside, star


def many(rings):
    x, y = np.concatenate(rings).T
    return overlay.Rings(x.copy(), y.copy(), np.concatenate([[0], np.cumsum([len(r) for r in rings])]))


def regular(n, x, y, size):
    at = np.arange(n) * 2 * math.pi / n
    return np.stack([x + size * np.cos(at), y + size * np.sin(at)], axis=1)


@pytest.mark.parametrize("at_once", [1 << 18, 7])
def test_pairs_together_equal_pairs_alone(monkeypatch, at_once):
    monkeypatch.setattr(overlay, "AT_ONCE", at_once)
    r = random.Random(4)
    a = [star(r, r.uniform(0, 9), r.uniform(0, 9), r.randint(3, 12), 6) for _ in range(60)]
    b = [star(r, r.uniform(0, 9), r.uniform(0, 9), r.randint(3, 12), 6) for _ in range(60)]
    a[7], b[7], a[8], b[8], b[9] = CONCAVE, CONCAVE, CONCAVE, CONCAVE + (10, 0), a[9] * 0.5
    both, meets = overlay.overlap_areas(many(a), many(b)), overlay.meeting(many(a), many(b))
    assert both == pytest.approx([polygons.overlap_area(x, y) for x, y in zip(a, b)])
    assert meets.tolist() == [polygons.meet(x, y) for x, y in zip(a, b)]
    assert both[7] == pytest.approx(86) and both[8] == 0 and meets[8] and (both > 0).sum() > 20
    assert many(a).areas() == pytest.approx([abs(polygons.signed_area(x)) for x in a])
    at = np.random.default_rng(0).uniform(-6, 16, (100_000, 2))
    for k in (0, 1, 2, 3):
        assert both[k] == pytest.approx((inside(a[k], *at.T) & inside(b[k], *at.T)).mean() * 22 * 22, abs=1.0)


def test_large_rings_in_little_memory():
    a, b = regular(1000, 0, 0, 10), regular(1000, 5, 1, 10)
    tracemalloc.start()
    area = polygons.overlap_area(a, b)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    d = math.hypot(5, 1)
    lens = 2 * 100 * math.acos(d / 20) - d / 2 * math.sqrt(400 - d * d)
    assert area == pytest.approx(lens, rel=1e-4) and most < 100e6


ODD = [
    (1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]),
    (2, [(0.0, 0.0), (4.0, 0.0), (float("inf"), 4.0)]),
    (3, [(0.0, 0.0), (4.0, float("nan")), (4.0, 4.0)]),
    (4, [(0.0, 0.0), None, (4.0, 4.0), (0.0, 4.0)]),
    (5, [(0.0, 0.0), (None, 1.0), (4.0, 4.0)]),
    (6, [(0.0, 0.0), (4.0, 0.0)]),
    (7, []),
    (8, None),
    (9, [(0.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 4.0)]),
    (10, [(1.0, 1.0), (1.0, 1.0), (1.0, 1.0)]),
    (11, [(3.0, 1.0), (9.0, 1.0), (9.0, 2.0), (3.0, 2.0)]),
]


def test_odd_rings_join_with_nothing(spark):
    df = spark.createDataFrame(ODD, f"k long, ring {polygons.RING}")
    assert [(x.k, x.o_k) for x in polygons.polygon_overlaps(df, "k", "ring", 3.0).collect()] == [(1, 11)]
    pairs = {(x.k, x.o) for x in polygons.polygons_meeting(df, df.withColumnRenamed("k", "o"), "k", "o", "ring", 3.0).collect()}
    assert pairs == {(a, b) for a in (1, 9, 10) for b in (1, 9, 10)} | {(1, 11), (11, 1), (11, 11)}
    assert polygons.union_area(df, "ring", 3.0).first().area == pytest.approx(16 + 5.0)
    pixels = spark.createDataFrame([(y, x, 1.0) for y in range(12) for x in range(12)], "row int, col int, v double")
    found = {x.k: x.n_pixels for x in polygons.zone_background(pixels, df, "k", "ring", 0.0, 2.0, 3.0, "v").collect()}
    assert len(found) == len(ODD) and all(found[k] == 0 for k in range(2, 9)) and found[1] > 0


def test_large_and_small_rings_meet_across_levels(spark):
    r = random.Random(9)
    rings = [(i, star(r, r.uniform(0, 900), r.uniform(0, 900), r.randint(3, 7), r.choice([2, 8, 40, 300]))) for i in range(150)]
    rings += [(900, np.array([(-20_000, -20_000), (20_000, -20_000), (20_000, 20_000), (-20_000, 20_000)], dtype=float))]
    df = frame(spark, rings)
    got = {(x.k, x.o_k): x.ratio for x in polygons.polygon_overlaps(df, "k", "ring", 4.0).collect()}
    share = lambda a, b: polygons.overlap_area(a, b) / min(abs(polygons.signed_area(a)), abs(polygons.signed_area(b)))
    want = {(i, j): v for i, a in rings for j, b in rings if i < j and (v := share(a, b)) > 0}
    assert got == pytest.approx(want) and sum(j == 900 for _, j in got) == 150
    cells = polygons._at_levels(polygons._boxes(df, "k", "ring", "a", 4.0), "a", list(range(15)), 4.0)
    assert cells.groupBy("ak", "level").count().agg(F.max("count")).first()[0] <= 4


def test_overlays(spark):
    a, b = frame(spark, [(1, CONCAVE)]), frame(spark, [(5, CONCAVE + (3, 2)), (6, CONCAVE + (50, 0))])
    (x,) = polygons.polygon_overlays(a, b, "k", "k", "ring", 5.0).collect()
    both = polygons.overlap_area(CONCAVE, CONCAVE + (3, 2))
    assert (x.k, x.o_k) == (1, 5) and (x.both, x.either, x.only, x.o_only) == pytest.approx((both, 172 - both, 86 - both, 86 - both))


def box(x, y, w, h):
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], dtype=float)


def test_upright_rectangles():
    odd = [box(0, 0, 2, 1)[[0, 2, 1, 3]], box(0, 0, 2, 1) + [(0, 0), (0, 0), (0, 0.1), (0, 0)], CONCAVE, CONCAVE[:3], regular(5, 0, 0, 1)]
    real = [box(1, 2, 3, 4), box(1, 2, 3, 4)[::-1], box(1, 2, 3, 4)[[1, 2, 3, 0]], box(1, 2, 3, 4)[[0, 1, 2, 3, 0]], box(1, 2, 0, 4)]
    assert many(odd + real).upright().tolist() == [False] * len(odd) + [True] * len(real)
    rings, at = many(odd + real), np.array([7, 0, 2, 7])
    assert rings.take(at).x.tolist() == np.concatenate([(odd + real)[i][:, 0] for i in at]).tolist() and rings.take(at).first.tolist() == [0, 4, 8, 16, 20]


@pytest.mark.parametrize("rows", [1, 5, 100])
def test_whole_groups(rows):
    r = np.random.default_rng(1)
    keys = np.sort(r.integers(0, 9, 40)), np.arange(40) // 7
    order = np.lexsort(keys[::-1])
    table = pa.table({"a": keys[0][order], "b": keys[1][order], "v": np.arange(40)})
    seen, groups = [], set()
    for part, number in overlay.whole_groups(iter(table.to_batches(max_chunksize=6)), ("a", "b"), rows):
        own = list(zip(part["a"].to_pylist(), part["b"].to_pylist(), strict=True))
        assert len(set(zip(own, number.tolist(), strict=True))) == len(set(own)) == len(set(number.tolist())) and not groups & set(own)
        groups |= set(own)
        seen += part["v"].to_pylist()
    assert seen == list(range(40))


def mixed(r, n, first=0):
    """Boxes and stars of several sizes, some in one place."""
    made = lambda s: box(r.randint(0, 40), r.randint(0, 40), s * r.randint(1, 3), s * r.randint(1, 3)) if r.random() < 0.7 else star(r, r.uniform(0, 40), r.uniform(0, 40), r.randint(3, 7), 3 * s)
    return [(first + i, made(r.choice([1, 1, 2, 2, 15]))) for i in range(n)] + [(first + n + i, box(8, 8, 3, 3)) for i in range(9)]


@pytest.mark.parametrize("rings, points", [(16_384, 131_072), (3, 131_072), (16_384, 20)])
def test_blocks_of_a_cell_meet_like_the_cell(spark, monkeypatch, rings, points):
    monkeypatch.setattr(polygons, "BLOCK_RINGS", rings)
    monkeypatch.setattr(polygons, "BLOCK_POINTS", points)
    r = random.Random(11)
    mine, theirs = mixed(r, 70), mixed(r, 40, 50)
    a, b = frame(spark, mine), frame(spark, theirs)
    area = lambda v: abs(polygons.signed_area(v))
    both = lambda p, q: [(i, j, v, area(x), area(y)) for i, x in p for j, y in q if (v := polygons.overlap_area(x, y)) > 0]
    listed = lambda df: sorted((x.k, x.o_k, *x[2:]) for x in df.collect())
    want = both(mine, theirs)
    got = listed(polygons.polygon_overlays(a, b, "k", "k", "ring", 4.0))
    assert [x[:2] for x in got] == sorted(x[:2] for x in want)
    for x, (_, _, v, p, q) in zip(got, sorted(want), strict=True):
        assert x[2:] == pytest.approx((v, p + q - v, p - v, q - v), abs=1e-9)
    got = {x[:2]: x[2] for x in listed(polygons.polygon_overlaps(a, "k", "ring", 4.0, b))}
    assert got == pytest.approx({(i, j): v / min(p, q) for i, j, v, p, q in want if i != j})
    # Keys that are strings have another order; a key that two rings share makes no pair, a null none at all.
    named = a.select(F.when(F.col("k") < 75, F.col("k").cast("string")).when(F.col("k") < 77, "same").alias("k"), "ring")
    name = lambda i: str(i) if i < 75 else "same" if i < 77 else None
    found = [(name(i), name(j), v / min(p, q)) for i, j, v, p, q in both(mine, mine) if name(i) and name(j) and name(i) < name(j)]
    got = listed(polygons.polygon_overlaps(named, "k", "ring", 4.0))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(found)] and [x[2] for x in got] == pytest.approx([x[2] for x in sorted(found)])


def test_pairs_are_made_where_they_are_measured(spark):
    """A pair costs no row with two rings: the rings of a cell come once, and pairs are found and measured there."""
    n = 1500
    df = frame(spark, [(i, box(i % 7, i % 5, 12, 12)) for i in range(n)])
    pairs = polygons.polygon_overlaps(df, "k", "ring", 40.0)
    overlays = polygons.polygon_overlays(df.where("k % 2 = 0"), df.where("k % 2 = 1"), "k", "k", "ring", 40.0)
    for out, many_ in ((pairs, n * (n - 1) // 2), (overlays, n * n // 4)):
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == many_


def test_cells_of_other_shapes_have_smaller_blocks(spark):
    """Rings that must be swept meet in blocks whose sweeps take about as long as those of rectangles."""
    shapes = {"box": box(1, 1, 12, 12), "closed": box(1, 1, 12, 12)[[0, 1, 2, 3, 0]], "triangle": box(1, 1, 12, 12)[:3], "slanted": box(1, 1, 12, 12) + [(0, 0), (0, 0), (0, 0), (3, 0)]}
    for name, ring in shapes.items():
        held = polygons._held(polygons._boxes(frame(spark, [(i, ring) for i in range(5000)]), "k", "ring", "a", 40.0).withColumn("aid", F.col("ak")), [0], 40.0)
        (c,) = polygons._cells_held({"a": held}).collect()
        assert (c.a_own_n, c.a_fine_n, c.a_fine, c.a_own, c.weight) == (5000, 0, 0, *((1, 1) if name in ("box", "closed") else (3, 65)))


@pytest.mark.parametrize("limit", [512, 3])
def test_union_area_equals_a_fine_grid(spark, monkeypatch, limit):
    monkeypatch.setattr(polygons, "CELL_RINGS", limit)
    monkeypatch.setattr(polygons, "DEPTH", 4)
    r = random.Random(6)
    rings = [(i, star(r, r.uniform(2, 28), r.uniform(2, 28), r.randint(3, 9), 6)) for i in range(24)]
    rings += [(i + 50, ring) for i, ring in rings[:5]] + [(99, np.array([(4, 4), (20, 4), (20, 18), (4, 18)], dtype=float))]
    df = frame(spark, rings).withColumn("g", F.when(F.col("k") % 2 == 0, "even"))
    got = {x.g: x.area for x in polygons.union_area(df, "ring", 7.0, ["g"]).collect()}
    n = 900
    x, y = (v.ravel() for v in np.meshgrid((np.arange(n) + 0.5) * 44 / n - 7, (np.arange(n) + 0.5) * 44 / n - 7))
    for g, odd in (("even", 0), (None, 1)):
        covered = np.zeros(n * n, dtype=bool)
        for k, ring in rings:
            if k % 2 == odd:
                covered |= inside(ring, x, y)
        assert got[g] == pytest.approx(covered.mean() * 44 * 44, rel=2e-3)
    assert polygons.union_area(df.limit(0), "ring", 7.0).first().area == 0 and polygons.union_area(df.limit(0), "ring", 7.0, ["g"]).count() == 0


def distance(ring, x, y):
    best = np.full(len(x), np.inf)
    for a, b in zip(ring, np.roll(ring, -1, axis=0)):
        d = b - a
        t = np.clip(((x - a[0]) * d[0] + (y - a[1]) * d[1]) / max(d @ d, 1e-300), 0, 1)
        best = np.minimum(best, np.hypot(x - a[0] - t * d[0], y - a[1] - t * d[1]))
    return best


@pytest.mark.parametrize("size", [2.0, 13.0])
def test_ring_zones(spark, size):
    r = random.Random(2)
    value = {(y, x): r.choice([None, float("nan"), *map(float, range(20))]) for y in range(50) for x in range(50)}
    pixels = spark.createDataFrame([(y, x, v) for (y, x), v in value.items()], "row int, col int, v double").withColumn("distance", F.lit("clash"))
    rings = {i: star(r, r.uniform(5, 45), r.uniform(5, 45), r.randint(3, 8), 9) for i in range(6)}
    rings[7] = CONCAVE + (20, 20)
    zones = frame(spark, list(rings.items()))
    x, y = (g.ravel() + 0.5 for g in np.meshgrid(range(50), range(50)))
    owned = np.any([inside(ring, x, y) for ring in rings.values()], axis=0)
    found = {}
    for p in polygons.ring_zones(pixels, zones, "k", "ring", 1.5, 4.0, size).collect():
        found.setdefault(p.k, {})[p.row, p.col] = p.distance
    for k, ring in rings.items():
        d = distance(ring, x, y)
        at = ~owned & (d > 1.5) & (d <= 4.0)
        assert found.get(k, {}) == pytest.approx({(int(b), int(a)): v for a, b, v in zip(x[at], y[at], d[at])})
    for p in polygons.zone_background(pixels, zones, "k", "ring", 1.5, 4.0, size, "v", least=20).collect():
        own = [v for at in found.get(p.k, {}) if (v := value[at]) is not None and v == v]
        assert (p.n_pixels, p.background) == (len(own), float(np.median(own)) if len(own) >= 20 else None)
