"""Group profiles, distributions and agreement measures as plain aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.scalar import col, safe_ratio
from fieldloom.operators.relational import prefix_sums

MAD_TO_SIGMA = 1.4826


def dense_counts(df: DataFrame, key: str, classes: DataFrame) -> DataFrame:
    """Rows of each class of the (small) class table; absent classes count 0."""
    return classes.join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(*classes.columns, F.coalesce("n", F.lit(0)).alias("n"))


def group_profile(df: DataFrame, key: str, score: str, area: str, poor: Column, null_as_zero: bool = True) -> DataFrame:
    """n, means, sum and share of poor rows of each group. null_as_zero: whether nulls count as 0 in the mean or not at all."""
    value = F.coalesce(F.col(score), F.lit(0.0)) if null_as_zero else F.col(score)
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean_score"), F.sum(F.coalesce(area, F.lit(0.0))).alias("sum_area"), F.count_if(poor).alias("n_poor")).withColumn("poor_share", safe_ratio("n_poor", "n"))


def top_supported(profile: DataFrame, least: int, order: Sequence[Column], k: int) -> DataFrame:
    """The k first groups among those with enough rows."""
    return profile.where(F.col("n") >= least).orderBy(*order).limit(k)


#: Values of a group up to which a task may hold them all.
FEW_VALUES = 1_000_000


def quantiles(df: DataFrame, value: str, at: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles of each group as an array `q`, and `n`. Nulls do not count. A group without
    values has no row.

    Where every group has FEW_VALUES values at most, which is counted first, one aggregate does it. Else the larger ones
    are ranked by prefix sums, so that no task holds the values of a whole group. The keys of the larger groups, one for
    FEW_VALUES rows at most, go to all tasks: a join by them would bring a whole group to one.
    """
    keys = list(keys)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("__n"))
    large = sizes.where(F.col("__n") > FEW_VALUES)
    if large.isEmpty():
        return _small_quantiles(df, value, at, keys)
    if not keys:
        return _ranked_quantiles(df, value, at, keys)
    mine = F.broadcast(large.select(*(F.col(k).alias(f"__l{i}") for i, k in enumerate(keys))))
    on = [F.col(k).eqNullSafe(F.col(f"__l{i}")) for i, k in enumerate(keys)]
    return _small_quantiles(df.join(mine, on, "left_anti"), value, at, keys).unionByName(_ranked_quantiles(df.join(mine, on, "left_semi"), value, at, keys))


def _small_quantiles(df: DataFrame, value: str, at: Sequence[float], keys: Sequence[str]) -> DataFrame:
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.percentile(v, F.array(*(F.lit(float(p)) for p in at))).alias("q")).where("n > 0").select(*keys, "n", "q")


def _ranked_quantiles(df: DataFrame, value: str, at: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Rows are counted by value, and prefix sums over the sorted values give every value its ranks."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    ranked = prefix_sums(counts, [*(F.col(k).asc_nulls_first() for k in keys), F.col("__v").asc()], ["__n"])
    groups = ranked.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.sum("__n").alias("n"), F.min("__n_before").alias("__first"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    both = ranked.join(F.broadcast(groups), on) if keys else ranked.crossJoin(F.broadcast(groups))
    low, parts = F.col("__n_before") - F.col("__first"), []
    for i, p in enumerate(at):
        place = (F.col("n") - 1) * F.lit(float(p))
        for rank in (F.floor(place), F.ceil(place)):
            parts.append(F.max(F.when((low <= rank) & (rank < low + F.col("__n")), F.col("__v"))).alias(f"__q{len(parts)}"))
    found = both.groupBy(*keys, "n").agg(*parts)
    share = lambda p: (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
    # Of equal neighbours the value itself, so that infinities and rounding do no harm.
    q = [F.when(F.col(f"__q{2 * i}") == F.col(f"__q{2 * i + 1}"), F.col(f"__q{2 * i}")).otherwise(F.col(f"__q{2 * i}") * (1 - share(p)) + F.col(f"__q{2 * i + 1}") * share(p)) for i, p in enumerate(at)]
    return found.select(*keys, "n", F.array(*q).alias("q"))


def percentile_profile(df: DataFrame, value: str, keys: Sequence[str] = (), at: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Exact linearly interpolated percentiles with count, extremes, mean and population deviation."""
    plain = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    own = quantiles(df, value, at, keys).select(*(F.col(k).alias(f"__{k}") for k in keys), "q")
    out = plain.join(own, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left") if keys else plain.join(F.broadcast(own), F.lit(True), "left")
    return out.select(*keys, "n", "min", *(F.col("q")[i].alias(f"p{round(100 * p):02d}") for i, p in enumerate(at)), "max", "mean", "std")


def quantile_profile(df: DataFrame, value: str, at: Sequence[float], above: float) -> DataFrame:
    """One row: the quantiles as an array, and the share of the values above a threshold."""
    share = df.agg(F.avg((F.col(value) > above).cast("double")).alias("share_above"))
    return quantiles(df, value, at).crossJoin(F.broadcast(share))


def group_medians(df: DataFrame, rank: str, values: Sequence[str], shares: dict[str, Column]) -> DataFrame:
    """A row for each rank, in their order: n, the exact median of each value and the share of rows of each kind."""
    out = df.groupBy(rank).agg(F.count("*").alias("n"), *(F.avg(c.cast("double")).alias(k) for k, c in shares.items()))
    for v in values:
        own = quantiles(df, v, [0.5], [rank]).select(F.col(rank).alias("__r"), F.col("q")[0].alias(f"median_{v}"))
        out = out.join(own, F.col(rank).eqNullSafe(F.col("__r")), "left").drop("__r")
    return out.orderBy(rank)


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of the rows where both are known."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.corr(a, b).alias("pearson"), F.count("*").alias("n"))


def best_of_map(df: DataFrame, scores: str, k: int) -> DataFrame:
    """The k largest entries of all rows' maps (name to score), ties by name."""
    return df.select(F.explode(scores).alias("name", "score")).where(F.col("score").isNotNull()).orderBy(F.desc("score"), "name").limit(k)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of all bins; values beyond the range fall into the end bins, nulls and NaN into none."""
    good = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - low) / ((high - low) / bins)))).cast("int")
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(good.groupBy(at.alias("bin")).agg(F.count("*").alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def range_classes(df: DataFrame, value: str, edges: Sequence[tuple[float, float, str]], flags: dict[str, Column]) -> DataFrame:
    """Rows by range of a value, and how many have each flag."""
    name = F.lit(None).cast("string")
    for low, high, label in reversed(edges):
        name = F.when((F.col(value) >= low) & (F.col(value) < high), label).otherwise(name)
    return df.withColumn("range", name).where("range IS NOT NULL").groupBy("range").agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in flags.items()))


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Counts by two categories, one column for each of the given values."""
    return df.groupBy(rows).agg(*(F.count_if(F.col(columns) == F.lit(v)).alias(f"n_{v}") for v in values))


def most_common(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, of equal ones the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n")).alias("m"), F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value)).select(*keys, value, F.col("m.n").alias("n"))


def robust_z(df: DataFrame, value: str, out: str, reference: Column | None = None, eps: float | None = None) -> DataFrame:
    """(x - median) / (1.4826 MAD) against a reference population.

    eps None: a MAD of 0 falls back to the standard deviation, and a deviation of 0 to a z of 0. Else eps is added to
    the MAD. The two figures are one row, broadcast.
    """
    ref = df.where(reference) if reference is not None else df
    middle = quantiles(ref, value, [0.5]).select(F.col("q")[0].alias("__median"))
    apart = ref.crossJoin(F.broadcast(middle)).select(F.abs(F.col(value) - F.col("__median")).alias("__d"))
    spread = quantiles(apart, "__d", [0.5]).select(F.col("q")[0].alias("__mad"))
    one = ref.agg(F.stddev_pop(value).alias("__std")).join(F.broadcast(middle), F.lit(True), "left").join(F.broadcast(spread), F.lit(True), "left")
    scale = MAD_TO_SIGMA * F.col("__mad")
    z = (F.col(value) - F.col("__median")) / (scale + eps) if eps is not None else F.when(F.col("__mad") > 0, (F.col(value) - F.col("__median")) / scale).when(F.col("__std") > 0, (F.col(value) - F.col("__median")) / F.col("__std")).when(F.col(value).isNotNull(), 0.0)
    return df.crossJoin(F.broadcast(one)).withColumn(out, z).drop("__mad", "__median", "__std")


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the column's exact median."""
    one = df.sparkSession.range(1).select()
    for c in columns:
        one = one.join(F.broadcast(quantiles(df, c, [0.5]).select(F.col("q")[0].alias(f"__{c}"))), F.lit(True), "left")
    return df.crossJoin(F.broadcast(one)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")) for c in columns}).drop(*(f"__{c}" for c in columns))


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks from 1, equal values sharing the mean of theirs. Ranks come from prefix sums of the counts of values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ranked = prefix_sums(counts, [F.col("__v").asc()], ["__n"]).select("__v", (F.col("__n_before") + (F.col("__n") + 1) / 2.0).alias(out))
    return df.join(ranked, df[value] == F.col("__v"), "left").drop("__v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of the rows where both are known."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("__a"), F.col(b).alias("__b"))
    return average_ranks(average_ranks(both, "__a", "__ra"), "__b", "__rb").agg(F.corr("__ra", "__rb").alias("spearman"), F.count("*").alias("n"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve from the rank sum; null with a single class."""
    r = average_ranks(df.where(F.col(score).isNotNull()).select(F.col(score).alias("__s"), positive.alias("__y")), "__s", "__r")
    n1, n0 = F.count_if("__y"), F.count_if(~F.col("__y"))
    return r.agg(F.sum(F.when(F.col("__y"), F.col("__r"))).alias("rank_sum"), n1.alias("n_pos"), n0.alias("n_neg")).select(((F.col("rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"), "n_pos", "n_neg")


def balanced_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    recall = df.where(F.col(truth).isNotNull()).groupBy(truth).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("recall"))
    return recall.agg(F.avg("recall").alias("balanced_accuracy"), F.count("*").alias("classes"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labellings, 1 where they are the same up to names."""
    table = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    by = lambda k: table.groupBy(k).agg(F.sum("n").alias("m")).agg(pairs("m").alias(f"s_{k}"))
    one = table.agg(pairs("n").alias("s"), F.sum("n").alias("total")).crossJoin(F.broadcast(by(a))).crossJoin(F.broadcast(by(b)))
    expected = F.col(f"s_{a}") * F.col(f"s_{b}") / (F.col("total") * (F.col("total") - 1) / 2)
    most = (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("s") - expected) / (most - expected)).alias("adjusted_rand"))


def match_quality(n_found: Column, n_reference: Column, n_matched: Column) -> dict[str, Column]:
    precision, recall = n_matched / F.nullif(n_found, F.lit(0)), n_matched / F.nullif(n_reference, F.lit(0))
    return {"precision": precision, "recall": recall, "f1": 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))}


def bounds(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))


def orientation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Angle of the main axis of a set of points, and its elongation."""
    from fieldloom.functions.geometry import second_moments

    return df.agg(F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"), F.covar_pop(x, y).alias("sxy")).select(*(c.alias(k) for k, c in second_moments(F.col("sxx"), F.col("syy"), F.col("sxy")).items()))


def assignment_counts(reference: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """How many reference rows have 0, 1 or more rows assigned."""
    per = reference.select(key).join(assigned.groupBy(key).agg(F.count("*").alias("k")), key, "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    return per.agg(F.count_if(F.col("k") == 0).alias("none"), F.count_if(F.col("k") == 1).alias("one"), F.count_if(F.col("k") > 1).alias("several"))


def combined_ranking(a: DataFrame, b: DataFrame, key: str, k: int) -> DataFrame:
    """Keys by their rows in both tables together; ties by key."""
    both = a.groupBy(key).agg(F.count("*").alias("n")).unionByName(b.groupBy(key).agg(F.count("*").alias("n")))
    return both.groupBy(key).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), key).limit(k)


def progress(stages: DataFrame, weights: DataFrame) -> DataFrame:
    """Share of the stage weights that is done. stages: stage, done; weights: stage, weight."""
    return weights.join(stages, "stage", "left").agg((F.sum(F.when(F.col("done"), F.col("weight")).otherwise(0)) / F.sum("weight")).alias("progress"))


def timeline(steps: DataFrame, default: Sequence[str] = ()) -> DataFrame:
    """Last done step, current step and whether all are done. steps: pos, step, done. default: the steps, none of them
    done, that stand for an empty timeline."""
    if default:
        stand_in = steps.sparkSession.createDataFrame([(i, x, False) for i, x in enumerate(default)], "pos int, step string, done boolean")
        steps = steps.unionByName(stand_in.join(steps.limit(1).select(), how="left_anti", on=F.lit(True)))
    return steps.agg(F.max_by(F.when(F.col("done"), F.col("step")), F.when(F.col("done"), F.col("pos"))).alias("last_done"), F.min_by(F.when(~F.col("done"), F.col("step")), F.when(~F.col("done"), F.col("pos"))).alias("current"), F.bool_and("done").alias("all_done"))


def share_where(condition: Column | str) -> Column:
    return F.avg(col(condition).cast("double"))
