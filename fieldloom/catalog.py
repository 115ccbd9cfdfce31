"""Registered queries of the library, without those of the optional subpackage: each with DuckDB SQL where SQL can say it.

Survey tables are stood in for by the driver's: lines are suppliers, users or priorities, positions are arithmetic on
keys. Aggregated doubles are rounded on both sides, since the order of a sum is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import geometry, scalar
from fieldloom.operators import aggregates, grid, ml, relational, selection, sequence, spatial
from fieldloom.plans import runner
from fieldloom.sources import files
from fieldloom.streaming import events as ev

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


def _near(*names: str):
    """Rounded to a millionth as DuckDB does it, in floating point: for the rows of large joins, whose values are small."""
    return [(F.floor(F.col(n) * 1e6 + 0.5) / 1e6).alias(n) for n in names]


# Group profiles and distributions

_PROFILE = """SELECT l_suppkey, count(*) AS n, avg(coalesce(l_discount, 0)) AS mean_score, sum(coalesce(l_quantity, 0)) AS sum_area,
  count(*) FILTER (l_returnflag = 'R') AS n_poor, count(*) FILTER (l_returnflag = 'R') / greatest(1, count(*)) AS poor_share FROM lineitem GROUP BY l_suppkey"""


def _profile(s, d):
    return aggregates.group_profile(_t(s, d, "lineitem"), "l_suppkey", "l_discount", "l_quantity", F.col("l_returnflag") == "R")


@_query(f"SELECT l_suppkey, n, round(mean_score, 6) AS mean_score, round(sum_area, 2) AS sum_area, n_poor, round(poor_share, 6) AS poor_share FROM ({_PROFILE})")
def line_profile(s, d):
    return _profile(s, d).select("l_suppkey", "n", *_r("mean_score"), *_r("sum_area", digits=2), "n_poor", *_r("poor_share"))


@_query(f"SELECT l_suppkey, n, round(poor_share, 6) AS poor_share FROM ({_PROFILE}) WHERE n >= 10 ORDER BY poor_share DESC, l_suppkey LIMIT 8")
def lines_needing_attention(s, d):
    return aggregates.top_supported(_profile(s, d), 10, [F.desc("poor_share"), F.asc("l_suppkey")], 8).select("l_suppkey", "n", *_r("poor_share"))


@_query("SELECT n_nationkey, n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal < 0 GROUP BY ALL")
def dense_class_counts(s, d):
    c = _t(s, d, "customer").where("c_acctbal < 0").withColumnRenamed("c_nationkey", "n_nationkey")
    return aggregates.dense_counts(c, "n_nationkey", _t(s, d, "nation").select("n_nationkey", "n_name"))


@_query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def count_by_key(s, d):
    return _t(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


_DIST = "round(quantile_cont({c}, 0.1), 6) AS p10, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.9), 6) AS p90, count({c}) AS n, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std"


@_query(f"SELECT l_returnflag, {_DIST.format(c='l_extendedprice')} FROM lineitem GROUP BY l_returnflag")
def percentile_profile(s, d):
    return aggregates.percentile_profile(_t(s, d, "lineitem"), "l_extendedprice", ["l_returnflag"]).select("l_returnflag", "n", "min", "max", *_r("p10", "p50", "p90", "mean", "std"))


@_query("SELECT b::INT AS bin, count(value) AS n FROM range(40) t(b) LEFT JOIN (SELECT value, least(39, greatest(0, floor((value - 10) / 2.0)))::INT AS k FROM events WHERE value IS NOT NULL AND NOT isnan(value)) ON k = b GROUP BY b")
def histogram_clamped(s, d):
    return aggregates.histogram(_t(s, d, "events"), "value", 10.0, 90.0, 40)


@_query("SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS range, count(*) AS n, count(*) FILTER (p_retailprice > 1000) AS dear, count(*) FILTER (p_brand = 'Brand#11') AS brand FROM part GROUP BY 1")
def range_class_table(s, d):
    return aggregates.range_classes(_t(s, d, "part"), "p_size", [(0, 10, "small"), (10, 30, "medium"), (30, 1e9, "large")], {"dear": F.col("p_retailprice") > 1000, "brand": F.col("p_brand") == "Brand#11"})


@_query("SELECT quality, count(*) FILTER (toxic = 0) AS n_0, count(*) FILTER (toxic = 1) AS n_1 FROM labels GROUP BY quality")
def crosstab_counts(s, d):
    return aggregates.crosstab(_t(s, d, "labels"), "quality", "toxic", [0, 1])


@_query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1")
def most_common_value(s, d):
    return aggregates.most_common(_t(s, d, "events"), ["user_id"], "event_type")


_RZ = """WITH m AS (SELECT median({c}) AS md, stddev_pop({c}) AS sd FROM {t} WHERE {w}), q AS (SELECT median(abs({c} - md)) AS mad, any_value(md) AS md, any_value(sd) AS sd FROM {t}, m WHERE {w})
SELECT {k}, round(CASE WHEN mad > 0 THEN ({c} - md) / (1.4826 * mad) WHEN sd > 0 THEN ({c} - md) / sd WHEN {c} IS NOT NULL THEN 0 END, 6) AS z FROM {t}, q"""


@_query(_RZ.format(c="c_acctbal", t="customer", w="true", k="c_custkey"))
def robust_z(s, d):
    return aggregates.robust_z(_t(s, d, "customer"), "c_acctbal", "z").select("c_custkey", *_r("z"))


@_query(_RZ.format(c="p_retailprice", t="part", w="p_size < 20", k="p_partkey"))
def robust_z_by_population(s, d):
    return aggregates.robust_z(_t(s, d, "part"), "p_retailprice", "z", F.col("p_size") < 20).select("p_partkey", *_r("z"))


@_query("""WITH m AS (SELECT median(value) AS md FROM events), q AS (SELECT median(abs(value - md)) AS mad, any_value(md) AS md FROM events, m)
SELECT event_id, round((value - md) / (1.4826 * mad + 0.001), 6) AS z FROM events, q""")
def robust_z_epsilon(s, d):
    return aggregates.robust_z(_t(s, d, "events"), "value", "z", eps=0.001).select("event_id", *_r("z"))


@_query("SELECT p_partkey, round(0.6 * coalesce(p_size, 0) / 50 + 0.4 * coalesce(p_retailprice, 0) / 2000, 6) AS score, CASE WHEN p_size >= 40 THEN 'top' WHEN p_size >= 20 THEN 'middle' WHEN p_size >= 0 THEN 'low' END AS band, least(1, greatest(0, p_size / 40.0)) AS clipped FROM part")
def weighted_composite(s, d):
    p = _t(s, d, "part").withColumns({"a": F.col("p_size") / 50, "b": F.col("p_retailprice") / 2000})
    return p.select("p_partkey", F.round(scalar.weighted_sum({"a": 0.6, "b": 0.4}), 6).alias("score"), scalar.band("p_size", [(40, "top"), (20, "middle"), (0, "low")]).alias("band"), scalar.clip_or_zero(F.col("p_size") / 40.0, 0.0, 1.0).alias("clipped"))


@_query("""SELECT p_partkey, round(CASE WHEN z >= 0 THEN 1 - tail ELSE tail END, 8) AS p FROM (SELECT p_partkey, z, exp(-z * z / 2) / 2.5066282746310002 * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))) AS tail
FROM (SELECT p_partkey, (p_size - 25) / 10.0 AS z, 1 / (1 + 0.2316419 * abs((p_size - 25) / 10.0)) AS k FROM part))""")
def normal_probability(s, d):
    return _t(s, d, "part").select("p_partkey", F.round(scalar.normal_cdf((F.col("p_size") - 25) / 10.0), 8).alias("p"))


@_query("""WITH x AS (SELECT p_partkey, (p_size * 5)::DOUBLE AS r, (p_partkey % 200)::DOUBLE AS g, (p_partkey % 90)::DOUBLE AS b FROM part)
SELECT p_partkey, round((2*g-r-b)/(r+g+b), 6) AS exg, round(CASE WHEN g+r-b <> 0 THEN least(1, greatest(-1, (g-r)/(g+r-b))) END, 6) AS vari, round(CASE WHEN 2*g+r+b <> 0 THEN (2*g-r-b)/(2*g+r+b) END, 6) AS gli,
 round(CASE WHEN g <> 0 THEN r/g END, 6) AS rg_ratio, round((r+g+b)/3, 6) AS brightness,
 round(60 * CASE WHEN greatest(r,g,b)=least(r,g,b) THEN 0 WHEN greatest(r,g,b)=r THEN ((g-b)/(greatest(r,g,b)-least(r,g,b)) + 6) % 6 WHEN greatest(r,g,b)=g THEN (b-r)/(greatest(r,g,b)-least(r,g,b))+2 ELSE (r-g)/(greatest(r,g,b)-least(r,g,b))+4 END, 6) AS hue FROM x WHERE r + g + b <> 0""")
def colour_indices(s, d):
    x = _t(s, d, "part").select("p_partkey", (F.col("p_size") * 5).cast("double").alias("r"), (F.col("p_partkey") % 200).cast("double").alias("g"), (F.col("p_partkey") % 90).cast("double").alias("b")).where("r + g + b <> 0")
    return x.select("p_partkey", *(F.round(c, 6).alias(k) for k, c in scalar.colour_indices("r", "g", "b").items()))


@_query("SELECT s_suppkey, s_name, coalesce(s_acctbal, m)::DOUBLE AS s_acctbal FROM (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier), (SELECT median(s_acctbal) AS m FROM supplier WHERE s_suppkey % 3 <> 0)")
def median_imputation(s, d):
    x = _t(s, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("s_acctbal"))
    return aggregates.impute_median(x, ["s_acctbal"])


_RANKS = "(rank() OVER (ORDER BY {c}) + count(*) OVER (PARTITION BY {c}) / 2.0 - 0.5)"


@_query(f"SELECT round(corr(a, b), 6) AS spearman, count(*) AS n FROM (SELECT {_RANKS.format(c='l_quantity')} AS a, {_RANKS.format(c='l_extendedprice')} AS b FROM lineitem)")
def spearman(s, d):
    return aggregates.spearman(_t(s, d, "lineitem"), "l_quantity", "l_extendedprice").select(*_r("spearman"), "n")


@_query(f"SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc, count(*) FILTER (y) AS n_pos, count(*) FILTER (NOT y) AS n_neg FROM (SELECT quality = 1 AS y, {_RANKS.format(c='n_chars')} AS r FROM documents JOIN labels USING (doc_id))")
def auc_quality(s, d):
    return aggregates.auc(_t(s, d, "documents").join(_t(s, d, "labels"), "doc_id"), "n_chars", F.col("quality") == 1).select(*_r("auc"), "n_pos", "n_neg")


@_query("SELECT round(avg(r), 6) AS balanced_accuracy, count(*) AS classes FROM (SELECT avg((quality = CASE WHEN n_chars > 600 THEN 1 ELSE 0 END)::DOUBLE) AS r FROM documents JOIN labels USING (doc_id) GROUP BY quality)")
def balanced_accuracy(s, d):
    x = _t(s, d, "documents").join(_t(s, d, "labels"), "doc_id").withColumn("guess", F.when(F.col("n_chars") > 600, 1).otherwise(0))
    return aggregates.balanced_accuracy(x, "quality", "guess").select(*_r("balanced_accuracy"), "classes")


@_query("""WITH t AS (SELECT label, vec_id % 7 AS g, count(*)::DOUBLE AS n FROM embeddings GROUP BY ALL), s AS (SELECT sum(n*(n-1)/2) AS s, sum(n) AS t FROM t),
a AS (SELECT sum(m*(m-1)/2) AS s FROM (SELECT sum(n) AS m FROM t GROUP BY label)), b AS (SELECT sum(m*(m-1)/2) AS s FROM (SELECT sum(n) AS m FROM t GROUP BY g))
SELECT round((s.s - a.s*b.s/(t*(t-1)/2)) / ((a.s+b.s)/2 - a.s*b.s/(t*(t-1)/2)), 6) AS adjusted_rand FROM s, a, b""")
def adjusted_rand(s, d):
    return aggregates.adjusted_rand(_t(s, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("g")), "label", "g").select(*_r("adjusted_rand"))


@_query("SELECT c AS none, o AS one, m AS several FROM (SELECT count(*) FILTER (k = 0) AS c, count(*) FILTER (k = 1) AS o, count(*) FILTER (k > 1) AS m FROM (SELECT c_custkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1))")
def assignment_histogram(s, d):
    return aggregates.assignment_counts(_t(s, d, "customer").select(F.col("c_custkey").alias("k0")), _t(s, d, "orders").select(F.col("o_custkey").alias("k0")), "k0")


@_query("SELECT k, sum(n)::BIGINT AS n FROM (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events GROUP BY 1) GROUP BY k ORDER BY n DESC, k LIMIT 6")
def combined_line_ranking(s, d):
    return aggregates.combined_ranking(_t(s, d, "orders").select(F.col("o_orderpriority").alias("k")), _t(s, d, "events").select(F.col("event_type").alias("k")), "k", 6)


# Filters, order, pages, joins


@_query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE contains(lower(p_name), 'e') AND p_size >= 10 ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 25 OFFSET 25")
def filter_sort_page(s, d):
    keep = scalar.all_of([scalar.contains_ci("p_name", "E"), None, F.col("p_size") >= 10])
    rows, _, _ = relational.page(_t(s, d, "part").where(keep).select("p_partkey", "p_name", "p_size", "p_retailprice"), [relational.nulls_last("p_retailprice", True), F.asc("p_partkey")], 25, 2)
    return rows


@_query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 4")
def top_k(s, d):
    return relational.top(_t(s, d, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 4)


@_query("SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL")
def facet_values(s, d):
    return relational.facet(_t(s, d, "customer"), "c_mktsegment")


@_query("SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def join_one_to_one_left(s, d):
    return relational.one_to_one_left(_t(s, d, "documents").select("doc_id", "source"), _t(s, d, "labels"), "doc_id")


@_query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def unmatched_rows(s, d):
    return relational.unmatched(_t(s, d, "documents").select("doc_id", "lang"), _t(s, d, "labels"), "doc_id")


@_query("SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)")
def matched_rows(s, d):
    return relational.matched(_t(s, d, "documents").select("doc_id", "lang"), _t(s, d, "labels"), "doc_id")


@_query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_member FROM documents")
def membership_flag(s, d):
    return relational.membership(_t(s, d, "documents").select("doc_id"), _t(s, d, "labels").where("toxic = 1"), "doc_id")


@_query("SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_join(s, d):
    c = _t(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return relational.lookup(c, _t(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey").drop("n_nationkey")


@_query("SELECT 'S' || lpad(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey)::VARCHAR, 5, '0') AS id, s_suppkey FROM supplier")
def sequential_ids(s, d):
    return relational.sequential_ids(_t(s, d, "supplier").select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), F.asc("s_suppkey")], "S", 5).select("id", "s_suppkey")


@_query("SELECT c_custkey AS id, c_name AS name, NULL::BIGINT AS size FROM customer UNION ALL SELECT p_partkey, p_name, p_size FROM part")
def stacked_frames(s, d):
    return relational.stack(_t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), _t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size")))


@_query("SELECT p_partkey, format('{:.1f}', p_retailprice::DOUBLE) AS price, CASE WHEN regexp_matches(p_type, '(?i)steel') THEN 'steel' WHEN p_size > 25 THEN 'large' ELSE 'other' END AS label, CASE WHEN p_size >= 10 THEN p_brand ELSE 'Unclassified' END AS sure, regexp_replace(trim(p_name), '\\W+', '_', 'g')[:12] AS slug FROM part".replace("\\\\", "\\"))
def labels_and_text(s, d):
    return _t(s, d, "part").select("p_partkey", scalar.fmt_fixed("p_retailprice", 1).alias("price"), scalar.labels([(scalar.matches_ci("p_type", "steel"), "steel"), (F.col("p_size") > 25, "large")], "other").alias("label"), scalar.confident("p_brand", "p_size", 10).alias("sure"), scalar.tidy("p_name", length=12).alias("slug"))


# Selections

_KINDS = selection.Kinds({"status": "o_orderstatus", "line": "o_orderpriority"}, {"attention": "o_totalprice < 50000"})


@_query("SELECT count(*) FILTER (o_orderstatus = 'F') AS n, round(count(*) FILTER (o_orderstatus = 'F') / greatest(1, count(*)), 6) AS share, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice < 50000) AS n_poor, round(count(*) FILTER (o_orderstatus = 'F' AND o_totalprice < 50000) / greatest(1, count(*) FILTER (o_orderstatus = 'F')), 6) AS poor_share, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS mean_score, round(avg(o_orderkey) FILTER (o_orderstatus = 'F'), 4) AS mean_size FROM orders")
def selection_stats(s, d):
    chosen = _KINDS.predicate(selection.Selection.parse("status:F"))
    return selection.selection_stats(_t(s, d, "orders"), chosen, F.col("o_totalprice") < 50000, "o_totalprice", "o_orderkey").select("n", *_r("share"), "n_poor", *_r("poor_share"), *_r("mean_score", "mean_size", digits=4))


@_query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice < 50000 GROUP BY 1")
def selection_class_mix(s, d):
    return selection.class_mix(_t(s, d, "orders"), _KINDS.predicate(selection.Selection.parse("attention")), "o_orderstatus")


@_query("SELECT o_orderpriority, n, total, round(n / total, 6) AS share FROM (SELECT o_orderpriority, count(*) FILTER (o_totalprice < 50000) AS n, count(*) AS total FROM orders GROUP BY 1) WHERE n > 0 ORDER BY n DESC, o_orderpriority LIMIT 3")
def selection_ranked_lines(s, d):
    return selection.ranked_groups(_t(s, d, "orders"), _KINDS.predicate(selection.Selection.parse("attention")), "o_orderpriority", 3).select("o_orderpriority", "n", "total", *_r("share"))


# Ordered lines: events of a user along seconds


def _line(s, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return _t(s, d, "events").select("user_id", "event_id", "event_type", "value", seconds.alias("along"))


_LINE = "(SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1e6 AS along FROM events)"
_STEPS = f"(SELECT *, along - lag(along) OVER (PARTITION BY user_id ORDER BY along, event_id) AS step FROM {_LINE})"
_SPACING = f"(SELECT user_id, coalesce(median(step) FILTER (step BETWEEN 60 AND 500000), 3600) AS spacing FROM {_STEPS} GROUP BY user_id)"


@_query(f"SELECT user_id, event_id, round(step, 4) AS step FROM {_STEPS}")
def neighbour_gaps(s, d):
    return sequence.differences(_line(s, d), "user_id", "along", "event_id").select("user_id", "event_id", *_r("step", digits=4))


@_query(f"SELECT user_id, round(spacing, 4) AS spacing FROM {_SPACING}")
def typical_spacing(s, d):
    return sequence.typical_spacing(_line(s, d), "user_id", "along", 60, 500000, 3600.0).select("user_id", *_r("spacing", digits=4))


@_query(f"""WITH g AS (SELECT user_id, along AS f, lead(along) OVER (PARTITION BY user_id ORDER BY along, event_id) - along AS gap FROM {_LINE}), r AS (SELECT g.*, gap / spacing AS ratio FROM g JOIN {_SPACING} USING (user_id)),
n AS (SELECT *, round_even(ratio, 0)::INT - 1 AS n FROM r WHERE ratio BETWEEN 1.5 AND 6.0)
SELECT user_id, round(f + gap * k / (n + 1), 3) AS along, n, k::INT AS k FROM n, range(1, 8) t(k) WHERE n >= 1 AND k <= n""")
def inferred_missing(s, d):
    x = _line(s, d)
    return sequence.missing_positions(x, "user_id", "along", sequence.typical_spacing(x, "user_id", "along", 60, 500000, 3600.0), 1.5, 6.0, "event_id").select("user_id", F.round("along", 3).alias("along"), "n", "k")


@_query(f"""SELECT user_id, min(along) AS first, max(along) AS last, count(*) AS length FROM (SELECT user_id, along, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY along, event_id) AS i FROM {_LINE}) WHERE value > 20) GROUP BY user_id, g HAVING count(*) >= 3""")
def true_runs(s, d):
    return sequence.runs(_line(s, d), "user_id", "along", F.col("value") > 20, 3, "event_id")


@_query(f"SELECT user_id, event_id, sum(CASE WHEN p IS NULL OR along - p > 200000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY along, event_id)::BIGINT AS \"group\" FROM (SELECT *, lag(along) OVER (PARTITION BY user_id ORDER BY along, event_id) AS p FROM {_LINE})")
def gap_islands(s, d):
    return sequence.islands(_line(s, d), "user_id", "along", 200000.0, "event_id").select("user_id", "event_id", "group")


@_query(f"SELECT event_id, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY along, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), ',') AS near FROM {_LINE}")
def sequence_neighbours(s, d):
    x = sequence.neighbours(_line(s, d), "user_id", "along", "event_id", 4, "event_id")
    return x.select("event_id", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("near"))


@_query("SELECT event_id, lag(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS previous, lead(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS next FROM events")
def prev_next(s, d):
    return sequence.previous_next(_t(s, d, "events"), ["ts", "event_id"], "event_id", ["event_type"]).select("event_id", "previous", "next")


@_query("SELECT k, n, n < 0.8 * md AND g >= 3 AS small FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1), (SELECT median(n) AS md, count(*) AS g FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey))")
def demote_small_groups(s, d):
    return sequence.small_groups(_t(s, d, "lineitem").withColumnRenamed("l_suppkey", "k"), "k", 0.8)


@_query("SELECT l_orderkey, max(l_extendedprice) AS l_extendedprice, arg_max(l_partkey, (l_extendedprice, l_linenumber)) AS l_partkey, max(l_discount) AS l_discount, bool_or(l_returnflag = 'R') AS returned, round(avg(l_tax), 6) AS l_tax, count(*) AS n_parts FROM lineitem GROUP BY l_orderkey")
def representative_per_group(s, d):
    x = _t(s, d, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return sequence.representatives(x, ["l_orderkey"], "l_extendedprice", "l_linenumber", ["l_partkey"], ["l_discount"], ["returned"], ["l_tax"]).withColumn("l_tax", F.round("l_tax", 6))


@_query("SELECT c_mktsegment, round(mean, 4) AS mean, row_number() OVER (ORDER BY mean DESC, c_mktsegment)::INT AS rank, ['first', 'second', 'third'][row_number() OVER (ORDER BY mean DESC, c_mktsegment)] AS name FROM (SELECT c_mktsegment, avg(c_acctbal) AS mean FROM customer GROUP BY 1)")
def ranked_group_names(s, d):
    return sequence.ranked_names(_t(s, d, "customer"), "c_mktsegment", "c_acctbal", ["first", "second", "third"]).withColumn("mean", F.round("mean", 4))


@_query(None)
def chain_select(s, d):
    x = _line(s, d).select("user_id", "event_id", "along", (F.col("value") / 50 - 0.5).alias("score"))
    return sequence.chain_select(x, "user_id", "along", "score", 86400.0, 2.0).select("user_id", "event_id")


@_query(None)
def profile_peaks(s, d):
    x = _t(s, d, "lineitem").groupBy("l_suppkey", (F.col("l_quantity")).alias("at")).agg(F.avg("l_extendedprice").alias("height"))
    return sequence.peaks(x, "l_suppkey", "at", "height", 3.0, 1000.0)


# Space: positions from keys

_XY = "({k} * 7919 % 10007) / 10.0 AS x, ({k} * 104729 % 10009) / 10.0 AS y"


def _points(s, d, table, key, name):
    k = F.col(key)
    return _t(s, d, table).select(k.alias(name), (k * 7919 % 10007 / 10.0).alias("x"), (k * 104729 % 10009 / 10.0).alias("y"))


_C = f"(SELECT c_custkey AS c, {_XY.format(k='c_custkey')} FROM customer)"
_S = f"(SELECT s_suppkey AS s, {_XY.format(k='s_suppkey')} FROM supplier)"


@_query(f"SELECT floor(x / 100)::BIGINT AS bx, floor(y / 100)::BIGINT AS by, count(*) AS n FROM {_C} GROUP BY ALL")
def spatial_blocks(s, d):
    return _points(s, d, "customer", "c_custkey", "c").groupBy(scalar.block_id("x", "y", 100.0).alias("b")).agg(F.count("*").alias("n")).select("b.bx", "b.by", "n")


@_query(f"SELECT a.c, b.s, round(sqrt((a.x-b.x)**2 + (a.y-b.y)**2), 6) AS distance FROM {_C} a JOIN {_S} b ON sqrt((a.x-b.x)**2 + (a.y-b.y)**2) <= 40")
def radius_join(s, d):
    return spatial.radius_join(_points(s, d, "customer", "c_custkey", "c"), _points(s, d, "supplier", "s_suppkey", "s"), 40.0).select("a.c", "b.s", *_near("distance"))


@_query(f"SELECT c, s, round(distance, 6) AS distance FROM (SELECT c, s, distance, row_number() OVER (PARTITION BY c ORDER BY distance, s) AS r FROM (SELECT a.c, b.s, sqrt((a.x-b.x)**2 + (a.y-b.y)**2) AS distance FROM {_C} a, {_S} b)) WHERE r = 1")
def nearest_neighbour(s, d):
    return spatial.nearest(_points(s, d, "customer", "c_custkey", "c"), _points(s, d, "supplier", "s_suppkey", "s"), "c", "s", 40.0).select("c", "s", *_r("distance"))


_RING = [(100.0, 100.0), (800.0, 150.0), (700.0, 600.0), (450.0, 300.0), (200.0, 700.0)]
_TESTS = " + ".join(f"CASE WHEN ({a[1]} > y) <> ({b[1]} > y) AND x < ({b[0]} - {a[0]}) * (y - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]} THEN 1 ELSE 0 END" for a, b in zip(_RING, [*_RING[1:], _RING[0]], strict=True))


@_query(f"SELECT c, x, y FROM {_C} WHERE x BETWEEN 100 AND 800 AND y BETWEEN 100 AND 700 AND ({_TESTS}) % 2 = 1")
def area_selection(s, d):
    return spatial.in_ring(_points(s, d, "customer", "c_custkey", "c"), geometry.ring(_RING))


@_query(f"SELECT c, x, y FROM {_C} WHERE x BETWEEN 200 AND 500 AND y BETWEEN 300 AND 400")
def window_selection(s, d):
    return _points(s, d, "customer", "c_custkey", "c").where(geometry.rectangle("x", "y", 200, 300, 500, 400))


@_query(f"SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM {_C}")
def point_bounds(s, d):
    return aggregates.bounds(_points(s, d, "customer", "c_custkey", "c"), "x", "y").select("min_x", "min_y", "max_x", "max_y", *_r("mean_x", "mean_y"))


@_query(f"WITH m AS (SELECT var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy FROM {_C}) SELECT round(atan2(2 * sxy, sxx - syy) / 2, 6) AS angle, round(sqrt(((sxx+syy)/2 + sqrt(((sxx-syy)/2)**2 + sxy*sxy)) / ((sxx+syy)/2 - sqrt(((sxx-syy)/2)**2 + sxy*sxy))), 6) AS elongation FROM m")
def point_orientation(s, d):
    return aggregates.orientation(_points(s, d, "customer", "c_custkey", "c"), "x", "y").select(*_r("angle", "elongation"))


def _boxes(s, d):
    return _points(s, d, "customer", "c_custkey", "c").select("c", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 12 + F.col("c") % 7).alias("x1"), (F.col("y") + 12 + F.col("c") % 5).alias("y1"), (F.col("c") * 37 % 101).alias("priority"))


_B = "(SELECT c, x AS x0, y AS y0, x + 12 + c % 7 AS x1, y + 12 + c % 5 AS y1 FROM " + _C + ")"


@_query(f"SELECT a.c AS k, b.c AS o_k, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1-a.x0)*(a.y1-a.y0), (b.x1-b.x0)*(b.y1-b.y0)), 6) AS ratio FROM {_B} a JOIN {_B} b ON a.c < b.c AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)")
def overlap_join(s, d):
    return spatial.box_overlaps(_boxes(s, d), "c", 40.0).select("k", "o_k", *_near("ratio"))


@_query(None)
def overlap_suppression(s, d):
    b = _boxes(s, d)
    return spatial.suppress_dense(b, "c", "priority", lambda a, other: spatial.box_overlaps(a, "c", 40.0, other).where("ratio > 0.3")).select("c", "priority")


@_query(None)
def one_to_one_match(s, d):
    return spatial.greedy_match(_points(s, d, "customer", "c_custkey", "c"), _points(s, d, "supplier", "s_suppkey", "s"), "c", "s", 60.0)


@_query(f"SELECT c, l AS line, round(o, 6) AS offset FROM (SELECT c, l, y - (l * 50 + 0.1 * x) AS o, row_number() OVER (PARTITION BY c ORDER BY abs(y - (l * 50 + 0.1 * x)), l) AS r FROM {_C}, range(20) t(l)) WHERE r = 1".replace(" AS offset", ' AS "offset"'))
def nearest_line(s, d):
    lines = s.range(20).select(F.col("id").alias("line"), F.array(F.lit(0.0), F.lit(1100.0)).alias("xs"), F.array(F.col("id") * 50 + 0.0, F.col("id") * 50 + 110.0).alias("ys"))
    return spatial.nearest_line(_points(s, d, "customer", "c_custkey", "c"), lines, "line", "x", "y").select("c", "line", *_r("offset"))


# Grids: lineitem as pixels


def _pixels(s, d):
    return _t(s, d, "lineitem").groupBy((F.col("l_partkey") % 64).cast("int").alias("row"), (F.col("l_suppkey") % 64).cast("int").alias("col")).agg(F.sum("l_quantity").alias("value")).where("value > 60")


_P = "(SELECT (l_partkey % 64)::INT AS row, (l_suppkey % 64)::INT AS col, sum(l_quantity) AS value FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 60)"


@_query(f"SELECT (row // 4)::INT AS row, (col // 4)::INT AS col, round(CASE WHEN count(value) >= 4 THEN avg(value) END, 6) AS value, count(*) AS n FROM {_P} GROUP BY 1, 2")
def block_average(s, d):
    return grid.block_average(_pixels(s, d), 4, ["value"], 0.25).withColumn("value", F.round("value", 6))


@_query(f"WITH a AS (SELECT 3 AS z, row, col, value FROM {_P}), b AS (SELECT 2 AS z, row >> 1 AS row, col >> 1 AS col, avg(value) AS value FROM a GROUP BY ALL), c AS (SELECT 1 AS z, row >> 1 AS row, col >> 1 AS col, avg(value) AS value FROM b GROUP BY ALL) SELECT z, row, col, round(value, 6) AS value FROM (FROM a UNION ALL FROM b UNION ALL FROM c)")
def pyramid_rollup(s, d):
    return grid.pyramid(_pixels(s, d), "value", 3, 2).withColumn("value", F.round("value", 6))


@_query(f"SELECT a.row, a.col, a.value FROM {_P} a WHERE a.value >= 100 AND NOT EXISTS (SELECT 1 FROM {_P} b WHERE abs(b.row - a.row) <= 2 AND abs(b.col - a.col) <= 2 AND (b.value > a.value OR (b.value = a.value AND (b.row, b.col) < (a.row, a.col))))")
def local_maxima(s, d):
    return grid.local_maxima(_pixels(s, d), "value", 2, 100.0)


@_query(f"SELECT a.row, a.col, round(sum(b.value * exp(-((a.row-b.row)**2 + (a.col-b.col)**2) / 2.0)) / sum(exp(-((a.row-b.row)**2 + (a.col-b.col)**2) / 2.0)), 6) AS smoothed FROM {_P} a JOIN {_P} b ON abs(a.row - b.row) <= 3 AND abs(a.col - b.col) <= 3 GROUP BY ALL")
def gaussian_smoothing(s, d):
    return grid.smooth(_pixels(s, d), "value", 1.0).select("row", "col", *_r("smoothed"))


@_query(f"""WITH RECURSIVE p AS (SELECT row, col, row * 64 + col AS id FROM {_P} WHERE value > 160), e AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
r AS (SELECT id AS u, id AS v FROM p UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u), m AS (SELECT u, min(v) AS c FROM r GROUP BY u)
SELECT count(*) AS area, min(row) AS min_row, min(col) AS min_col, max(row) AS max_row, max(col) AS max_col FROM m JOIN p ON p.id = m.u GROUP BY c""")
def connected_patches(s, d):
    return grid.component_stats(grid.components(_pixels(s, d).where("value > 160"))).select("area", "min_row", "min_col", "max_row", "max_col")


_Z = "(SELECT zone, x0, x0 + 9 AS x1, y0, y0 + 7 AS y1 FROM (SELECT s_suppkey AS zone, (s_suppkey * 13 % 60)::INT AS x0, (s_suppkey * 29 % 60)::INT AS y0 FROM supplier WHERE s_suppkey <= 40))"


_Z_ALL = _Z.replace(" WHERE s_suppkey <= 40", "")


def _zones(s, d, only: str = "true"):
    k = F.col("s_suppkey")
    z = _t(s, d, "supplier").where(only).select(k.alias("zone"), (k * 13 % 60).cast("int").alias("x0"), (k * 29 % 60).cast("int").alias("y0"))
    return z.select("zone", "x0", (F.col("x0") + 9).alias("x1"), "y0", (F.col("y0") + 7).alias("y1"))


@_query(f"SELECT zone, {_DIST.format(c='value')} FROM (SELECT row, col, any_value(value) AS value, min(zone) AS zone FROM {_P} JOIN {_Z} ON col >= x0 AND col < x1 AND row >= y0 AND row < y1 GROUP BY row, col) GROUP BY zone")
def zonal_stats(s, d):
    return aggregates.percentile_profile(spatial.zonal_owner(_pixels(s, d), _zones(s, d, "s_suppkey <= 40"), "zone"), "value", ["zone"]).select("zone", "n", "min", "max", *_r("p10", "p50", "p90", "mean", "std"))


@_query(f"""SELECT zone, round(avg(value), 6) AS background, count(value) AS n_pixels FROM (SELECT zone, p.value FROM {_Z} z JOIN (SELECT * FROM {_P} p WHERE NOT EXISTS (SELECT 1 FROM {_Z} o WHERE p.col >= o.x0 AND p.col < o.x1 AND p.row >= o.y0 AND p.row < o.y1)) p
ON sqrt((z.x0 + 4 - p.col)**2 + (z.y0 + 3 - p.row)**2) > 6 AND sqrt((z.x0 + 4 - p.col)**2 + (z.y0 + 3 - p.row)**2) <= 12) GROUP BY zone""")
def ring_background(s, d):
    z = _zones(s, d, "s_suppkey <= 40")
    p = _pixels(s, d)
    centres = z.select("zone", (F.col("x0") + 4.0).alias("x"), (F.col("y0") + 3.0).alias("y"))
    return spatial.ring_background(p, centres, "zone", spatial.zonal_owner(p, z, "zone"), 6.0, 12.0, "value").select("zone", *_r("background"), "n_pixels")


@_query(f"SELECT zone, {_DIST.format(c='value')} FROM (SELECT row, col, any_value(value) AS value, min(zone) AS zone FROM {_P} JOIN {_Z_ALL} ON col >= x0 AND col < x1 AND row >= y0 AND row < y1 GROUP BY row, col) GROUP BY zone")
def zonal_stats_all(s, d):
    return aggregates.percentile_profile(spatial.zonal_owner(_pixels(s, d), _zones(s, d), "zone"), "value", ["zone"]).select("zone", "n", "min", "max", *_r("p10", "p50", "p90", "mean", "std"))


@_query(f"""SELECT zone, round(avg(value), 6) AS background, count(value) AS n_pixels FROM (SELECT zone, p.value FROM {_Z_ALL} z JOIN (SELECT * FROM {_P} p WHERE NOT EXISTS (SELECT 1 FROM {_Z_ALL} o WHERE p.col >= o.x0 AND p.col < o.x1 AND p.row >= o.y0 AND p.row < o.y1)) p
ON sqrt((z.x0 + 4 - p.col)**2 + (z.y0 + 3 - p.row)**2) > 6 AND sqrt((z.x0 + 4 - p.col)**2 + (z.y0 + 3 - p.row)**2) <= 12) GROUP BY zone""")
def ring_background_all(s, d):
    z = _zones(s, d)
    p = _pixels(s, d)
    centres = z.select("zone", (F.col("x0") + 4.0).alias("x"), (F.col("y0") + 3.0).alias("y"))
    return spatial.ring_background(p, centres, "zone", spatial.zonal_owner(p, z, "zone"), 6.0, 12.0, "value").select("zone", *_r("background"), "n_pixels")


@_query(f"SELECT t.row, t.col, round(sum(v / (sqrt((t.row-r)**2 + (t.col-c)**2)**2 + 1e-12)) / sum(1 / (sqrt((t.row-r)**2 + (t.col-c)**2)**2 + 1e-12)), 6) AS shift FROM (SELECT row, col FROM {_P} WHERE row % 8 = 0) t, (SELECT (s_suppkey * 7 % 64)::DOUBLE AS r, (s_suppkey * 11 % 64)::DOUBLE AS c, s_acctbal AS v FROM supplier WHERE s_suppkey <= 30) GROUP BY ALL")
def interpolated_field(s, d):
    k = F.col("s_suppkey")
    c = _t(s, d, "supplier").where("s_suppkey <= 30").select((k * 7 % 64).cast("double").alias("row"), (k * 11 % 64).cast("double").alias("col"), F.col("s_acctbal").alias("shift"))
    return grid.idw(_pixels(s, d).where("row % 8 = 0").select("row", "col"), c, "shift").select("row", "col", *_r("shift"))


@_query(f"SELECT t.row, t.col, round(sum(v / (sqrt((t.row-r)**2 + (t.col-c)**2)**2 + 1e-12)) / sum(1 / (sqrt((t.row-r)**2 + (t.col-c)**2)**2 + 1e-12)), 6) AS shift FROM (SELECT row, col FROM {_P}) t, (SELECT (s_suppkey * 7 % 64)::DOUBLE AS r, (s_suppkey * 11 % 64)::DOUBLE AS c, s_acctbal AS v FROM supplier) GROUP BY ALL")
def interpolated_field_all(s, d):
    k = F.col("s_suppkey")
    c = _t(s, d, "supplier").select((k * 7 % 64).cast("double").alias("row"), (k * 11 % 64).cast("double").alias("col"), F.col("s_acctbal").alias("shift"))
    return grid.idw(_pixels(s, d).select("row", "col"), c, "shift").select("row", "col", *_r("shift"))


@_query(f"SELECT x, y, z, tx::INT AS tx, ty::INT AS ty, tx::INT >> 3 AS file_x, ty::INT >> 3 AS file_y, tx::INT & 7 AS cell_x, ty::INT & 7 AS cell_y FROM (SELECT round(x, 3) AS x, round(y, 3) AS y, 17 AS z, floor((x + 20037508.342789244) / 40075016.685578488 * 131072) AS tx, floor((20037508.342789244 - y) / 40075016.685578488 * 131072) AS ty FROM (SELECT (x / 10 - 50) / 180 * 20037508.342789244 AS x, ln(tan(pi() / 4 + radians(y / 20 - 25) / 2)) / pi() * 20037508.342789244 AS y FROM {_C}))")
def tile_index(s, d):
    p = _points(s, d, "customer", "c_custkey", "c").select((F.col("x") / 10 - 50).alias("lon"), (F.col("y") / 20 - 25).alias("lat"))
    x, y = scalar.mercator("lon", "lat")
    tx, ty = scalar.tile_of(x, y, 17)
    t = p.select(F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.lit(17).alias("z"), tx.alias("tx"), ty.alias("ty"))
    return t.select("*", *(c.alias(k) for k, c in scalar.pack_cell("tx", "ty").items()))


# Models


@_query("SELECT query, vec_id, round(similarity, 5) AS similarity, rank FROM (SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id)::INT AS rank FROM embeddings e, embeddings q WHERE q.vec_id < 20 AND e.vec_id <> q.vec_id) WHERE rank <= 5")
def cosine_topk(s, d):
    e = _t(s, d, "embeddings").select("vec_id", "embedding")
    return ml.cosine_top(e, e.where("vec_id < 20"), "vec_id", "embedding", 5).select("query", "vec_id", F.round("similarity", 5).alias("similarity"), "rank")


@_query("SELECT query, vec_id, round(similarity, 5) AS similarity, rank FROM (SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id)::INT AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 5")
def cosine_topk_all(s, d):
    e = _t(s, d, "embeddings").select("vec_id", "embedding")
    return ml.cosine_top(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).select("query", "vec_id", F.round("similarity", 5).alias("similarity"), "rank")


@_query(f"""WITH b AS (SELECT c, floor(x / 100) AS bx, floor(y / 100) AS b_y FROM {_C}), g AS (SELECT bx, b_y, row_number() OVER (ORDER BY count(*) DESC, bx, b_y) - 1 AS i FROM b GROUP BY bx, b_y)
SELECT c, (CASE WHEN i % 10 < 5 THEN i % 10 ELSE 9 - i % 10 END)::INT AS fold FROM b JOIN g USING (bx, b_y)""")
def group_folds(s, d):
    return ml.folds(_points(s, d, "customer", "c_custkey", "c"), scalar.block_id("x", "y", 100.0), 5).select("c", "fold")


@_query(None)
def out_of_fold_auc(s, d):
    x = ml.vectors(_t(s, d, "documents").join(_t(s, d, "labels"), "doc_id").select("doc_id", "source", "quality", F.log(F.col("n_chars") + 1.0).alias("a"), F.length(F.regexp_replace("text", r"[^#*$%&|<>]", "")).cast("double").alias("b"), (F.length("text") / (F.size(F.split("text", " ")) + 0.0)).alias("c")), ["a", "b", "c"])
    rows = ml.out_of_fold(ml.folds(x, F.col("source"), 3).persist(), "quality", 3)
    return aggregates.auc(rows, "p", F.col("quality") == 1).select(*_r("auc", digits=4), "n_pos", "n_neg")


@_query(None)
def mixture_groups(s, d):
    x = ml.project(ml.vectors(_t(s, d, "embeddings"), ["embedding"]), 4)
    model, k, _ = ml.fit_mixture(x.select("vec_id", F.col("reduced").alias("features")), [2, 3], seeds=(1,))
    rows = ml.posterior_stats(model.transform(x.select("vec_id", F.col("reduced").alias("features"))), list(range(k)))
    return rows.select("vec_id", "group", F.round("group_p", 4).alias("group_p"))


# Documents and files


@_query("SELECT count(*) AS objects, count(DISTINCT l_suppkey) AS lines, round(median(l_extendedprice), 4) AS median_size, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90_size, count(*) FILTER (l_returnflag = 'R') AS poor, round(count(*) FILTER (l_returnflag = 'R') / greatest(1, count(*)), 6) AS poor_share, round(avg((l_discount > 0.05)::DOUBLE), 6) AS discounted, round(count(*) / 2.5, 4) AS per_hectare FROM lineitem")
def summary_document(s, d):
    rows = _t(s, d, "lineitem")
    q = aggregates.quantiles(rows, "l_extendedprice", [0.5, 0.9]).select(F.col("q")[0].alias("median_size"), F.col("q")[1].alias("p90_size"))
    lines = rows.select("l_suppkey").where("l_suppkey IS NOT NULL").distinct().agg(F.count("*").alias("lines"))
    x = rows.agg(F.count("*").alias("objects"), F.count_if(F.col("l_returnflag") == "R").alias("poor"), aggregates.share_where(F.col("l_discount") > 0.05).alias("discounted")).join(F.broadcast(q), F.lit(True), "left").crossJoin(F.broadcast(lines))
    return x.select("objects", "lines", *_r("median_size", "p90_size", digits=4), "poor", F.round(scalar.safe_ratio("poor", "objects"), 6).alias("poor_share"), *_r("discounted"), F.round(F.col("objects") / 2.5, 4).alias("per_hectare"))


@_query("""SELECT c_custkey::VARCHAR || ',' || '"' || c_name || ', ' || c_mktsegment || '"' || ',' AS line FROM customer""")
def csv_export(s, d):
    x = _t(s, d, "customer").select("c_custkey", F.concat_ws(", ", "c_name", "c_mktsegment").alias("label"), F.lit(None).cast("string").alias("note"))
    return x.select(files.csv_line(["c_custkey", "label", "note"]).alias("line"))


@_query("SELECT count(*) FILTER (s_acctbal > 0) AS good, count(*) FILTER (NOT coalesce(s_acctbal > 0, false)) AS broken FROM supplier")
def quarantine_split(s, d):
    good, bad = files.quarantine(_t(s, d, "supplier"), {"positive": F.col("s_acctbal") > 0})
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("broken")))


@_query("SELECT id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status FROM (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'running' END AS status FROM orders)")
def recovered_jobs(s, d):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    return runner.recover(_t(s, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.lit(None).cast("string").alias("error"))).select("id", "status")


# Extensions that are not from the surveyed work


@_query("SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, g")
def event_sessions(s, d):
    out = ev.sessions(_t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", *_r("total", digits=4))


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(s, d):
    return _t(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@_query("SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)::INT AS quarter, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders")
def window_frames(s, d):
    by = Window.partitionBy("o_orderpriority")
    return _t(s, d, "orders").select("o_orderkey", F.ntile(4).over(by.orderBy("o_totalprice", "o_orderkey")).alias("quarter"), F.round(F.avg("o_totalprice").over(by.orderBy("o_orderdate", "o_orderkey").rowsBetween(-5, 0)), 4).alias("moving"))


from fieldloom import catalog_objects  # noqa: E402, F401  more of the same, which needs the names above
