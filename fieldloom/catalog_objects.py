"""More registered queries: polygons, per-object features, windows of grids, profiles, and small operators by themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldloom.catalog import _C, _P, _S, _boxes, _near, _pixels, _points, _query, _r, _t
from fieldloom.functions import geometry, scalar
from fieldloom.functions.predicates import Holds, Missing, OneOf, Test, Within, loaded
from fieldloom.operators import aggregates, grid, mixtures, ml, polygons, registration, relational, selection, sequence, spatial, summary
from fieldloom.sources import files, rasters
from fieldloom.sources.store import cut, shared_dir

# Columns and small joins


@_query("SELECT s_name AS name, s_suppkey, 'survey' AS source, 2 AS version, NULL::DOUBLE AS height FROM supplier")
def column_subset(s, d):
    kept = scalar.renamed(scalar.present(_t(s, d, "supplier"), ["s_name", "s_height", "s_suppkey"]), {"s_name": "name", "s_absent": "x"})
    return scalar.with_missing(scalar.with_constants(kept, {"source": "survey", "version": 2}), {"height": "double"})


@_query("SELECT s_suppkey, s_nationkey FROM supplier")
def dropped_columns(s, d):
    return _t(s, d, "supplier").drop("s_name", "s_acctbal")


@_query("SELECT p_partkey, round(sqrt(4 * p_size / pi()), 6) AS diameter, round(ln(p_size + 1), 6) AS log_area FROM part")
def size_units(s, d):
    return _t(s, d, "part").select("p_partkey", F.round(scalar.equivalent_diameter("p_size"), 6).alias("diameter"), F.round(scalar.log_area("p_size"), 6).alias("log_area"))


@_query("SELECT event_id, CASE WHEN value > 60 AND NOT value < 80 THEN 1 WHEN value < 80 AND NOT value > 60 THEN 0 ELSE -1 END AS weak FROM events")
def weak_labels(s, d):
    return _t(s, d, "events").select("event_id", scalar.weak_label(F.col("value") > 60, F.col("value") < 80).alias("weak"))


@_query("SELECT event_id, (event_id % 7 + 1)::INT AS stage_no, event_type AS stage, (event_id % 50 / 2.0)::DOUBLE AS seconds FROM events")
def log_capture(s, d):
    e = _t(s, d, "events")
    begun = scalar.log_fields(F.format_string("[%d/7] %s", F.col("event_id") % 7 + 1, F.col("event_type")))
    done = scalar.log_fields(F.concat("event_type", F.lit(" done in "), (F.col("event_id") % 50 / 2.0).cast("string"), F.lit(" s")))
    return e.select("event_id", begun["stage_no"].alias("stage_no"), begun["stage"].alias("stage"), done["seconds"].alias("seconds"))


@_query("SELECT event_id, event_type AS kind, user_id::VARCHAR || ':x' AS value FROM events")
def selection_codec(s, d):
    kind, value = scalar.split_once(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string"), F.lit(":x")), ":")
    return _t(s, d, "events").select("event_id", kind.alias("kind"), value.alias("value"))


#: Dear or watched events, outside two stretches of values.
_WATCHED = (Test("event_type", "=", "click") | OneOf("user_id", (1, 2, 3, 5, 8, 13)) | (Test("value", ">", 97.5) & Holds("event_type", "I"))) & ~Within("value", ((10.0, 20.5), (40.0, 45.0))) & ~Missing("ts")


@_query("""SELECT event_id, w AS by_column, w AS by_sql, w AS by_document FROM (SELECT event_id, coalesce((event_type = 'click' OR user_id IN (1, 2, 3, 5, 8, 13) OR (value > 97.5 AND event_type ILIKE '%i%'))
AND NOT coalesce(value >= 10 AND value < 20.5 OR value >= 40 AND value < 45, false) AND ts IS NOT NULL, false) AS w FROM events)""")
def predicate_renderers(s, d):
    """One tree, rendered three ways."""
    return _t(s, d, "events").select("event_id", _WATCHED.column().alias("by_column"), F.expr(_WATCHED.sql("`")).alias("by_sql"), loaded(_WATCHED.json()).column().alias("by_document"))


@_query("""WITH o AS (SELECT c_nationkey AS line, count(*) FILTER (c_acctbal < 1000) AS n, count(*) AS total FROM customer GROUP BY 1), g AS (SELECT s_nationkey AS line, count(*) FILTER (s_acctbal < 3000) AS n, count(*) AS total FROM supplier GROUP BY 1)
SELECT line, n_objects + n_gaps AS n, total_objects + total_gaps AS total, n_objects, total_objects, n_gaps, total_gaps, round((n_objects + n_gaps) / (total_objects + total_gaps), 6) AS share FROM
(SELECT line, coalesce(o.n, 0) AS n_objects, coalesce(o.total, 0) AS total_objects, coalesce(g.n, 0) AS n_gaps, coalesce(g.total, 0) AS total_gaps FROM o FULL JOIN g USING (line)) WHERE n_objects + n_gaps > 0 ORDER BY n DESC, line LIMIT 6""")
def selection_over_tables(s, d):
    """Lines ranked by the objects and the gaps that a selection takes from them."""
    tables = {
        "objects": (_t(s, d, "customer").withColumnRenamed("c_nationkey", "line"), selection.Kinds({"line": "line"}, {"attention": Test("c_acctbal", "<", 1000.0)})),
        "gaps": (_t(s, d, "supplier").withColumnRenamed("s_nationkey", "line"), selection.Kinds({"line": "line"}, {"attention": Test("s_acctbal", "<", 3000.0)})),
    }
    return selection.ranked_over(tables, selection.Selection.parse("attention"), "line", 6).withColumn("share", F.round("share", 6))


@_query("SELECT vec_id, (vec_id // 256)::INT AS atlas, (vec_id % 256 // 16)::INT AS row, (vec_id % 16)::INT AS col FROM embeddings")
def atlas_places(s, d):
    return _t(s, d, "embeddings").select("vec_id", *(c.alias(k) for k, c in scalar.atlas_place("vec_id").items()))


@_query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join(s, d):
    c = _t(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return relational.inner(_t(s, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey").select("o_orderkey", "c_name")


@_query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def guarded_join(s, d):
    r = _t(s, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    relational.check_contained(_t(s, d, "nation"), r, "n_regionkey")
    return relational.one_to_one_left(_t(s, d, "nation"), r, "n_regionkey", check=False).select("n_name", "r_name")


@_query("SELECT position, n_name FROM (SELECT n_nationkey, (n_nationkey * 7 % 25)::INT AS position FROM nation) JOIN nation USING (n_nationkey)")
def lookup_in_order(s, d):
    n = _t(s, d, "nation")
    return relational.lookup_in_order(n.select("n_nationkey", (F.col("n_nationkey") * 7 % 25).cast("int").alias("position")), n.select("n_nationkey", "n_name"), "n_nationkey", "position").select("position", "n_name")


@_query("SELECT doc_id, CASE WHEN toxic IS NOT NULL THEN 0.25 ELSE 0.5 END::DOUBLE AS p FROM documents LEFT JOIN labels USING (doc_id)")
def final_scores(s, d):
    rows = _t(s, d, "documents").select("doc_id", F.lit(0.5).alias("p"))
    return ml.final_scores(rows, _t(s, d, "labels").select("doc_id", F.lit(0.25).alias("p")), "doc_id")


@_query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') || '-' || substr(md5(event_id::VARCHAR), 1, 6) AS job FROM events")
def job_names(s, d):
    return _t(s, d, "events").select("event_id", scalar.job_id("ts", "event_id").alias("job"))


# Profiles


_FIGURES = {
    "objects": {"n": "count(*)", "lines": "count(DISTINCT l_suppkey)", "quantity": "sum(l_quantity)", "mean_quantity": "avg(l_quantity)", "sd_quantity": "stddev_samp(l_quantity)", "per_hectare": "count(*) / 2.5e0"},
    "health": {"poor": "count(*) FILTER (WHERE l_returnflag = 'R')", "poor_share": "count(*) FILTER (WHERE l_returnflag = 'R') / greatest(1, count(*))", "watch": "count(*) FILTER (WHERE l_discount > 0.05)", "watch_share": "avg(CASE WHEN l_discount > 0.05 THEN 1e0 ELSE 0e0 END)", "mean": "avg(l_discount)", "sd": "stddev_samp(l_discount)"},
    "size": {"low": "min(l_extendedprice)", "high": "max(l_extendedprice)", "mean": "avg(l_extendedprice)", "sd": "stddev_samp(l_extendedprice)"},
    "extent": {"first": "min(l_partkey)", "last": "max(l_partkey)", "part_mean": "avg(l_partkey)"},
}
_CLASSES = {"flags": ("l_returnflag", ("A", "N", "R")), "status": ("l_linestatus", ("F",))}
_SHARES = {"p05": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
_RANKS = {"size": ("l_extendedprice", _SHARES), "tax": ("l_tax", {"p50": 0.5, "p90": 0.9})}


def _figures_sql() -> str:
    own = [f"SELECT '{s}' AS section, '{n}' AS name, ({x})::DOUBLE AS value FROM lineitem" for s, named in _FIGURES.items() for n, x in named.items()]
    own += [f"SELECT '{s}', '{v}', count(*) FILTER (WHERE {c} = '{v}')::DOUBLE FROM lineitem" for s, (c, values) in _CLASSES.items() for v in values]
    own += [f"SELECT '{s}', 'other', count(*) FILTER (WHERE {c} IS NULL OR {c} NOT IN ({', '.join(repr(v) for v in values)}))::DOUBLE FROM lineitem" for s, (c, values) in _CLASSES.items()]
    own += [f"SELECT '{s}', '{n}', quantile_cont({c}, {p}) FROM lineitem" for s, (c, named) in _RANKS.items() for n, p in named.items()]
    return f"SELECT section, name, round(value, 4) AS value FROM ({' UNION ALL '.join(own)})"


@_query(_figures_sql())
def nested_document(s, d):
    made = summary.nested(_t(s, d, "lineitem"), {k: {n: F.expr(x) for n, x in named.items()} for k, named in _FIGURES.items()}, _CLASSES, _RANKS)
    return summary.flattened(made).withColumn("value", F.round("value", 4))


_NINE = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


@_query(f"SELECT k::INT AS k, round(q, 6) AS q, share_above FROM (SELECT unnest(quantile_cont(value, [{', '.join(map(str, _NINE))}])) AS q, unnest(range(9)) AS k, round(avg((value > 75)::DOUBLE), 6) AS share_above FROM events)")
def nine_point_profile(s, d):
    return aggregates.quantile_profile(_t(s, d, "events"), "value", _NINE, 75.0).select(F.posexplode("q").alias("k", "q"), F.round("share_above", 6).alias("share_above")).withColumn("q", F.round("q", 6))


@_query("SELECT p_size, count(*) AS n, round(median(p_retailprice), 6) AS median_p_retailprice, round(avg((p_brand = 'Brand#11')::DOUBLE), 6) AS brand FROM part GROUP BY p_size")
def group_medians(s, d):
    return aggregates.group_medians(_t(s, d, "part"), "p_size", ["p_retailprice"], {"brand": F.col("p_brand") == "Brand#11"}).select("p_size", "n", *_r("median_p_retailprice", "brand"))


@_query(f"SELECT round(corr(value, (row + col)::DOUBLE), 6) AS pearson, count(*) AS n FROM {_P} WHERE row % 3 = 0 AND col % 3 = 0")
def sampled_correlation(s, d):
    sample = grid.sample_every(_pixels(s, d), 3).withColumn("place", (F.col("row") + F.col("col")).cast("double"))
    return aggregates.pearson(sample, "value", "place").select(*_r("pearson"), "n")


@_query("SELECT name, score FROM (SELECT s_name || '-' || unnest(['a', 'b']) AS name, unnest([s_acctbal, -s_acctbal]) AS score FROM supplier) ORDER BY score DESC, name LIMIT 8")
def best_trials(s, d):
    scores = F.create_map(F.concat("s_name", F.lit("-a")), "s_acctbal", F.concat("s_name", F.lit("-b")), -F.col("s_acctbal"))
    return aggregates.best_of_map(_t(s, d, "supplier").select(scores.alias("scores")), "scores", 8)


@_query("""WITH c AS (SELECT p_partkey, 0.7 * p_retailprice / 1000 + 0.3 * p_size AS v FROM part), m AS (SELECT median(v) AS md FROM c), q AS (SELECT median(abs(v - md)) AS mad, any_value(md) AS md FROM c, m)
SELECT p_partkey, round((v - md) / (1.4826 * mad), 6) AS z FROM c, q""")
def restandardised_composite(s, d):
    p = _t(s, d, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("a"), F.col("p_size").cast("double").alias("b"))
    return aggregates.robust_z(p.withColumn("v", scalar.weighted_sum({"a": 0.7, "b": 0.3})), "v", "z").select("p_partkey", *_r("z"))


@_query("SELECT round(sum(CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey + 1 ELSE 0 END) / sum(n_regionkey + 1), 6) AS progress FROM nation")
def stage_progress(s, d):
    n = _t(s, d, "nation")
    return aggregates.progress(n.select(F.col("n_name").alias("stage"), (F.col("n_nationkey") % 3 == 0).alias("done")), n.select(F.col("n_name").alias("stage"), (F.col("n_regionkey") + 1).alias("weight"))).select(*_r("progress"))


@_query("SELECT arg_max(n_name, n_nationkey) FILTER (n_nationkey % 3 = 0) AS last_done, arg_min(n_name, n_nationkey) FILTER (n_nationkey % 3 <> 0) AS current, false AS all_done FROM nation")
def job_timeline(s, d):
    steps = _t(s, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("step"), (F.col("n_nationkey") % 3 == 0).alias("done"))
    return aggregates.timeline(steps, ["start", "end"])


@_query("""WITH k AS (SELECT s_suppkey AS line, (s_acctbal + 1000) AS y FROM supplier), l AS (SELECT line, y, lead(y) OVER (ORDER BY y, line) AS u FROM k)
SELECT line, round(u - y, 6) AS distance FROM l WHERE u IS NOT NULL""")
def line_spacing(s, d):
    """Each supplier is a slanted line; where it lies is its balance."""
    y = F.col("s_acctbal") + 1000
    knots = _t(s, d, "supplier").select(F.col("s_suppkey").alias("line"), y.alias("at"), F.array(F.lit(0.0), F.lit(1100.0)).alias("xs"), F.array(y, y + 110.0).alias("ys"))
    return sequence.line_distances(knots, "line", "at", [100.0, 500.0, 900.0], "xs", "ys").select("line", F.round("distance", 6).alias("distance"))


# Grids


@_query(f"SELECT (row // 2)::INT AS row, (col // 2)::INT AS col, round(sum(value * (row % 3)) / nullif(sum(row % 3), 0), 6) AS value, round(sum(row % 3) / 4, 6) AS alpha FROM {_P} GROUP BY 1, 2")
def alpha_downsample(s, d):
    p = _pixels(s, d).withColumn("alpha", F.pmod("row", F.lit(3)).cast("double"))
    return grid.alpha_average(p, 2, ["value"], "alpha").select("row", "col", *_r("value", "alpha"))


@_query(f"SELECT r.i::INT AS row, c.i::INT AS col, coalesce(value, -1.0) AS value FROM range(-3, 9) r(i), range(58, 70) c(i) LEFT JOIN {_P} p ON p.row = r.i AND p.col = c.i")
def boundless_window(s, d):
    return grid.boundless(_pixels(s, d), -3, 58, 12, 12, "value", -1.0)


@_query(f"SELECT row, col, value FROM {_P} WHERE row % 16 BETWEEN 3 AND 12 AND col BETWEEN 20 AND 49")
def raster_window(s, d):
    """Written as raster files of 16 rows each; only the tiles of the window are read again."""
    pixels = _pixels(s, d).select("row", "col", "value")
    folder = f"{shared_dir(s)}/fieldloom-rasters-{uuid.uuid4().hex}"
    made = cut(rasters.write_bands(pixels, folder, 16, kind="tiff"), "rasters")
    found = rasters.read(s, folder, window=(3, 13, 20, 50)).where("value IS NOT NULL").withColumn("band", F.regexp_extract("path", r"rows-(\d+)", 1).cast("long"))
    return found.join(made.select("band", "rows"), "band").select((F.col("band") * F.col("rows") + F.col("row")).cast("int").alias("row"), "col", "value")


@_query(f"SELECT row, col, row::DOUBLE AS x0, (10.0 * (col + 0.5) + 100)::DOUBLE AS x, (500 - 5.0 * (row + 0.5))::DOUBLE AS y FROM {_P}")
def pixel_places(s, d):
    return grid.pixel_centres(_pixels(s, d).select("row", "col"), (10.0, 0.0, 100.0, 0.0, -5.0, 500.0)).withColumn("x0", F.col("row") + F.lit(0.0))


@_query(f"""WITH RECURSIVE p AS (SELECT row, col FROM {_P} WHERE value > 90), box AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM p),
f AS (SELECT r::INT AS row, c::INT AS col FROM (SELECT unnest(range(r0, r1 + 1)) AS r, c0, c1 FROM box), range(0, 64) t(c) WHERE c BETWEEN c0 AND c1 AND (r, c) NOT IN (SELECT (row, col) FROM p)),
o AS (SELECT row, col FROM f, box WHERE row IN (r0, r1) OR col IN (c0, c1) UNION SELECT f.row, f.col FROM o JOIN f ON abs(f.row - o.row) + abs(f.col - o.col) = 1)
SELECT row, col FROM p UNION ALL SELECT row, col FROM f WHERE (row, col) NOT IN (SELECT (row, col) FROM o)""")
def filled_holes(s, d):
    return grid.fill_holes(_pixels(s, d).where("value > 90").select("row", "col"))


@_query(f"SELECT patch FROM (SELECT DISTINCT (row // 4) * 100 + col // 4 AS patch FROM {_P}) WHERE patch NOT IN (SELECT (row // 4) * 100 + col // 4 FROM {_P} WHERE (row * 7 + col) % 29 = 0)")
def uncovered_patches(s, d):
    p = _pixels(s, d)
    patches = p.select("row", "col", (F.floor(F.col("row") / 4) * 100 + F.floor(F.col("col") / 4)).alias("patch"))
    return spatial.uncovered(patches, "patch", p.where("(row * 7 + col) % 29 = 0"))


#: Where the profile of an angle is summed: bins across, one pixel wide.
_ACROSS = "SELECT k, any_value(a) AS a, sum(s * s / n) / sum(n) - (sum(s) / sum(n))**2 AS variance FROM (SELECT k, any_value(a) AS a, sum(value) AS s, count(value) AS n FROM {angles}, p GROUP BY k, floor(col * cos(radians(a)) + row * sin(radians(a)) + 1e-9)) GROUP BY k"
_BEST = "SELECT a FROM ({}) ORDER BY variance DESC, a LIMIT 1"


@_query(f"""WITH p AS (SELECT * FROM {_P}), t0 AS (SELECT i AS k, i * 3.0::DOUBLE AS a FROM range(60) r(i)), b0 AS ({_BEST.format(_ACROSS.format(angles="t0"))}),
t1 AS (SELECT i AS k, a + i * 0.3::DOUBLE AS a FROM b0, range(-10, 11) r(i)), b1 AS ({_BEST.format(_ACROSS.format(angles="t1"))}),
t2 AS (SELECT i AS k, a + i * 0.05::DOUBLE AS a FROM b1, range(-6, 7) r(i)), f AS ({_ACROSS.format(angles="t2")})
SELECT round(a - 180 * floor(a / 180), 4) AS angle, round(variance, 4) AS variance FROM f ORDER BY f.variance DESC, a LIMIT 1""")
def row_orientation(s, d):
    return grid.orientation(_pixels(s, d), "value").select(*_r("angle", "variance", digits=4))


@_query("SELECT vec_id AS row, (generate_subscripts(embedding, 1) - 1)::INT AS col, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings")
def registered_grid(s, d):
    """The vectors as a grid, a row for each, against the same moved by two rows and three columns: it comes back in place."""
    p = _t(s, d, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "value")).withColumn("value", F.col("value").cast("double"))
    moved = p.select((F.col("row") + 2).alias("row"), (F.col("col") - 3).alias("col"), "value")
    return registration.registered(p, moved, "value", 32, 16).select("row", "col", *_r("value"))


# Polygons


def _rings(s, d):
    at = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return _boxes(s, d).withColumn("ring", F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1")))


_BOX = f"(SELECT c, x AS x0, y AS y0, x + 12 + c % 7 AS x1, y + 12 + c % 5 AS y1 FROM {_C})"
#: Right triangles with corners (x, y), (x + 30, y), (x, y + 20), once for each supplier.
_TRI = f"(SELECT s, x, y FROM {_S})"


def _triangles(s, d):
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = F.col("x"), F.col("y")
    return _points(s, d, "supplier", "s_suppkey", "s").withColumn("ring", F.array(at(x, y), at(x + 30, y), at(x, y + 20)))


@_query(f"SELECT a.c AS k, b.c AS o_k, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1-a.x0)*(a.y1-a.y0), (b.x1-b.x0)*(b.y1-b.y0)), 6) AS ratio FROM {_BOX} a JOIN {_BOX} b ON a.c < b.c AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)")
def polygon_overlap_join(s, d):
    return polygons.polygon_overlaps(_rings(s, d), "c", "ring", 40.0).select("k", "o_k", *_near("ratio"))


@_query(f"SELECT c, count(*) > 0 AND any_value(s) IS NOT NULL AS meets FROM {_BOX} b LEFT JOIN {_TRI} t ON x1 >= x AND x0 <= x + 30 AND y1 >= y AND y0 <= y + 20 AND (greatest(x0, x) - x) / 30 + (greatest(y0, y) - y) / 20 <= 1 GROUP BY c")
def polygon_intersects(s, d):
    return polygons.meets_any(_rings(s, d), _triangles(s, d), "c", "s", "ring", 40.0).select("c", "meets")


_ZONES = "(SELECT s_suppkey AS zone, (s_suppkey * 13 % 60)::DOUBLE AS x, (s_suppkey * 29 % 60)::DOUBLE AS y FROM supplier)"


def _zone_triangles(s, d):
    k = F.col("s_suppkey")
    z = _t(s, d, "supplier").select(k.alias("zone"), (k * 13 % 60).cast("double").alias("x"), (k * 29 % 60).cast("double").alias("y"))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = F.col("x"), F.col("y")
    return z.select("zone", F.array(at(x, y), at(x + 9, y), at(x, y + 7.3)).alias("ring"))


_OWNED = f"(SELECT row, col, any_value(value) AS value, min(zone) AS zone FROM {_P} JOIN {_ZONES} ON col + 0.5 > x AND row + 0.5 > y AND (col + 0.5 - x) / 9 + (row + 0.5 - y) / 7.3 < 1 GROUP BY row, col)"


@_query(f"SELECT row, col, value, zone FROM {_OWNED}")
def polygon_zones(s, d):
    return polygons.zone_owner(_pixels(s, d), _zone_triangles(s, d), "zone", "ring", 10.0)


@_query(f"""WITH o AS (SELECT *, (row * 3 % 256)::DOUBLE AS r, value % 256 AS g, col::DOUBLE AS b FROM {_OWNED}),
a AS (SELECT zone, count(value) AS n_pixels, quantile_cont(value, 0.1) AS p10, median(value) AS p50, quantile_cont(value, 0.9) AS p90, avg(value) AS mean, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(CASE WHEN r + g + b = 0 THEN NULL WHEN (2 * g - r - b) / (r + g + b) > 0.1 THEN 1.0 ELSE 0.0 END) AS green_fraction FROM o GROUP BY zone)
SELECT zone, 32.85::DOUBLE AS area, round(16.3 + sqrt(81 + 53.29), 6) AS perimeter, n_pixels, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90, round(mean, 6) AS mean, round((2 * g - r - b) / nullif(r + g + b, 0), 6) AS exg, round(green_fraction, 6) AS green_fraction FROM {_ZONES} LEFT JOIN a USING (zone)""")
def object_features(s, d):
    p = _pixels(s, d).withColumns({"r": F.pmod(F.col("row") * 3, F.lit(256)).cast("double"), "g": F.col("value") % 256, "b": F.col("col").cast("double")})
    out = polygons.object_features(p, _zone_triangles(s, d), "zone", "ring", 10.0, "value", ("r", "g", "b"))
    return out.select("zone", *_r("area", "perimeter"), "n_pixels", *_r("p10", "p50", "p90", "mean", "exg", "green_fraction"))


@_query(f"""SELECT a.c AS k, b.c AS o_k, round(w, 6) AS both, round(sa + sb - w, 6) AS either, round(sa - w, 6) AS only, round(sb - w, 6) AS o_only FROM (SELECT a.c, b.c AS o, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS w,
(a.x1-a.x0)*(a.y1-a.y0) AS sa, (b.x1-b.x0)*(b.y1-b.y0) AS sb FROM {_BOX} a JOIN {_BOX} b ON a.c % 2 = 0 AND b.c % 2 = 1 AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)) t JOIN {_BOX} a ON a.c = t.c JOIN {_BOX} b ON b.c = t.o""")
def polygon_overlay(s, d):
    rings = _rings(s, d)
    return polygons.polygon_overlays(rings.where("c % 2 = 0"), rings.where("c % 2 = 1"), "c", "c", "ring", 16.0).select("k", "o_k", *_near("both", "either", "only", "o_only"))


@_query(f"""WITH b AS (SELECT c % 3 AS g, x0, y0, x1, y1 FROM {_BOX}), e AS (SELECT g, x FROM (SELECT g, x0 AS x FROM b UNION SELECT g, x1 FROM b)),
s AS (SELECT g, x, lead(x) OVER (PARTITION BY g ORDER BY x) AS u FROM e),
i AS (SELECT s.g, s.x, s.u, y0, y1, max(y1) OVER (PARTITION BY s.g, s.x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s JOIN b ON b.g = s.g AND b.x0 <= s.x AND b.x1 >= s.u)
SELECT g, round(sum((u - x) * greatest(0, y1 - greatest(y0, coalesce(top, y0)))), 4) AS area FROM i GROUP BY g""")
def polygon_union_area(s, d):
    rings = _rings(s, d).withColumn("g", F.col("c") % 3)
    return polygons.union_area(rings, "ring", 50.0, ["g"]).select("g", F.round("area", 4).alias("area"))


_NEAR = "(SELECT min(sqrt((px - ax - t * dx)**2 + (py - ay - t * dy)**2)) FROM (SELECT *, greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) AS t FROM (VALUES (x, y, 9.0, 0.0), (x + 9, y, -9.0, 7.3), (x, y + 7.3, 0.0, -7.3)) AS e(ax, ay, dx, dy)))"


@_query(f"""WITH f AS (SELECT col + 0.5 AS px, row + 0.5 AS py, value FROM {_P} WHERE (row, col) NOT IN (SELECT (row, col) FROM {_OWNED})), z AS (SELECT DISTINCT x, y FROM {_ZONES}),
n AS (SELECT x, y, count(value) AS n_pixels, median(value) AS background FROM (SELECT x, y, value, {_NEAR} AS d FROM z, f WHERE px > x - 6 AND px < x + 15 AND py > y - 6 AND py < y + 14) WHERE d > 1.2 AND d <= 5 GROUP BY x, y)
SELECT zone, coalesce(n_pixels, 0) AS n_pixels, CASE WHEN n_pixels >= 5 THEN round(background, 6) END AS background FROM {_ZONES} LEFT JOIN n USING (x, y)""")
def ring_zone_background(s, d):
    return polygons.zone_background(_pixels(s, d), _zone_triangles(s, d), "zone", "ring", 1.2, 5.0, 8.0, "value", least=5).select("zone", "n_pixels", *_r("background"))


@_query(f"SELECT c FROM {_BOX} WHERE x0 < 500.05 AND x1 > 500.05 AND y0 < 420.05 AND y1 > 420.05 ORDER BY c LIMIT 1")
def pick_at_point(s, d):
    return spatial.pick(_rings(s, d), "ring", 500.05, 420.05, [F.asc("c")]).select("c")


@_query(f"""WITH spot AS (SELECT s, x, y FROM {_S} WHERE s % 2 = 0), other AS (SELECT x, y FROM {_S} WHERE s % 2 = 1),
near AS (SELECT c, min(sqrt((c.x - o.x)**2 + (c.y - o.y)**2)) AS other FROM {_C} c JOIN other o ON sqrt((c.x - o.x)**2 + (c.y - o.y)**2) <= 50 GROUP BY c),
p AS (SELECT s, c, sqrt((c.x - t.x)**2 + (c.y - t.y)**2) AS distance FROM spot t JOIN {_C} c ON sqrt((c.x - t.x)**2 + (c.y - t.y)**2) <= 50)
SELECT s, c, round(distance, 6) AS distance FROM (SELECT p.*, row_number() OVER (PARTITION BY s ORDER BY distance, c) AS r FROM p LEFT JOIN near USING (c) WHERE other IS NULL OR distance <= other) WHERE r = 1""")
def nearest_unless_closer(s, d):
    p = _points(s, d, "supplier", "s_suppkey", "s")
    return spatial.nearest_unless_closer(p.where("s % 2 = 0"), _points(s, d, "customer", "c_custkey", "c"), p.where("s % 2 = 1"), "s", "c", 50.0).select("s", "c", *_r("distance"))


@_query(f"""SELECT '{{"type":"Feature","properties":{{"s":' || s || '}},"geometry":{{"type":"Polygon","coordinates":[[[' || round(x, 3) || ',' || round(y, 3) || '],[' || round(x + 30, 3) || ',' || round(y, 3) || '],[' || round(x, 3) || ',' || round(y + 20, 3) || '],[' || round(x, 3) || ',' || round(y, 3) || ']]]}}}}' AS value FROM (SELECT s, x::DOUBLE AS x, y::DOUBLE AS y FROM {_S})""")
def polygon_features(s, d):
    return files.shape_features(_triangles(s, d), "Polygon", "ring", ["s"], 3)


@_query(f"SELECT c, round((x - 500) * 0.001 * 111194.92664455873 * cos(radians(0.01)), 4) AS dx, round((y * 0.001 - 0.01) * 111194.92664455873, 4) AS dy FROM {_C}")
def local_offsets(s, d):
    p = _points(s, d, "customer", "c_custkey", "c").select("c", (F.col("x") * 0.001).alias("lon"), (F.col("y") * 0.001).alias("lat"))
    dx, dy = geometry.local_metres("lon", "lat", 0.5, 0.01)
    return p.select("c", F.round(dx, 4).alias("dx"), F.round(dy, 4).alias("dy"))


# Without SQL (a recursion over all rows is too slow there; tests/test_polygons.py has the sequential version)


@_query(None)
def polygon_suppression(s, d):
    rows = _rings(s, d)
    return spatial.suppress_dense(rows, "c", "priority", lambda a, other: polygons.polygon_overlaps(a, "c", "ring", 40.0, other).where("ratio > 0.3")).select("c", "priority")


def _weekly(s, d):
    """Positions on lines, a line for each supplier: where in its width a discount puts them, by weeks."""
    week = F.floor(F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")) / 7)
    return _t(s, d, "lineitem").select(week.alias("block"), (F.col("l_suppkey") * 10 + F.round(F.col("l_discount") * 10, 1)).alias("at")).groupBy("block", "at").agg(F.count("*").alias("n"))


@_query(None)
def track_links(s, d):
    return sequence.link_tracks(_weekly(s, d), "block", "at", 0.15, 4).select("block", "at", "n", "track")


@_query(f"""WITH b AS (SELECT c, floor(x / 100) AS bx, floor(y / 100) AS b_y FROM {_C}), g AS (SELECT bx, b_y, row_number() OVER (ORDER BY count(*) DESC, bx, b_y) - 1 AS i FROM b GROUP BY bx, b_y)
SELECT c, (CASE WHEN i % 10 < 5 THEN i % 10 ELSE 9 - i % 10 END)::INT AS fold FROM b JOIN g USING (bx, b_y)""")
def spatial_folds(s, d):
    return ml.folds(_points(s, d, "customer", "c_custkey", "c"), scalar.block_id("x", "y", 100.0), 5).select("c", "fold")


@_query(f"""WITH RECURSIVE g AS (SELECT floor(x / 100) AS bx, floor(y / 100) AS b_y, count(*) AS n FROM {_C} GROUP BY bx, b_y), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, bx, b_y) AS i FROM g),
d AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS held, -1 AS fold UNION ALL
SELECT d.i + 1, list_transform(held, lambda v, k: CASE WHEN k = list_position(held, list_min(held)) THEN v + n ELSE v END), list_position(held, list_min(held)) - 1 FROM d JOIN o ON o.i = d.i + 1)
SELECT c, fold::INT AS fold FROM (SELECT c, floor(x / 100) AS bx, floor(y / 100) AS b_y FROM {_C}) JOIN o USING (bx, b_y) JOIN d USING (i)""")
def greedy_folds(s, d):
    return ml.greedy_folds(_points(s, d, "customer", "c_custkey", "c"), scalar.block_id("x", "y", 100.0), 5).select("c", "fold")


def _sizes(s, d):
    return _t(s, d, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), "p_retailprice").alias("features"))


@_query("""WITH m AS (SELECT count(*) AS n, avg(p_size) AS a, avg(p_retailprice) AS b, var_pop(p_size) AS aa, covar_pop(p_size, p_retailprice) AS ab, var_pop(p_retailprice) AS bb FROM part),
l AS (SELECT *, -n / 2.0 * (2 * ln(2 * pi()) + ln(aa * bb - ab * ab) + 2) AS loglik FROM m)
SELECT round(a, 4) AS mean_size, round(b, 4) AS mean_price, round(aa, 4) AS var_size, round(ab, 4) AS covariance, round(bb, 2) AS var_price, round(loglik, 1) AS loglik, round(-2 * loglik + 5 * ln(n), 1) AS bic FROM l""")
def normal_fit(s, d):
    """One group: the sums of the tasks against the closed form."""
    model, bic = mixtures.fit(_sizes(s, d), [1], ridge=0.0)
    (a, b), ((aa, ab), (_, bb)) = model.means[0].tolist(), model.covariances[0].tolist()
    one = s.createDataFrame([(a, b, aa, ab, bb, float(model.loglik), float(bic[1]))], "mean_size double, mean_price double, var_size double, covariance double, var_price double, loglik double, bic double")
    return one.select(*_r("mean_size", "mean_price", "var_size", "covariance", digits=4), *_r("var_price", digits=2), *_r("loglik", "bic", digits=1))


@_query(None)
def mixture_models(s, d):
    """The group of each part in the mixture that the BIC prefers."""
    rows = _sizes(s, d)
    model, _ = mixtures.fit(rows, [1, 2, 3], rounds=30, tolerance=1e-4)
    return mixtures.assign(rows, model).select("p_partkey", "group", *_r("group_p", digits=4))


@_query(None)
def mixture_stability(s, d):
    rows = _sizes(s, d)
    model, _ = mixtures.fit(rows, [2], rounds=20, tolerance=1e-4)
    runs = mixtures.stability(rows, "p_partkey", model, runs=3, rounds=20, tolerance=1e-4)
    return runs.agg(F.count("*").alias("runs"), F.round(F.avg("adjusted_rand"), 4).alias("mean"), F.round(F.min("adjusted_rand"), 4).alias("least"))
