"""Light modelling: spatial folds, balanced logistic regression, mixtures chosen by BIC, stability."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fieldloom.operators.relational import numbered
from fieldloom.sources.store import cut


def vectors(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Numeric or one array column(s) as an ML vector."""
    if len(columns) == 1 and df.schema[columns[0]].dataType.typeName() == "array":
        return df.withColumn(out, array_to_vector(F.col(columns[0]).cast("array<double>")))
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def folds(df: DataFrame, group: Column, k: int) -> DataFrame:
    """Rows with a fold such that a group is in one fold: groups by falling size, dealt back and forth over the folds."""
    sizes = df.groupBy(group.alias("__g")).agg(F.count("*").alias("__n"))
    turn = F.pmod(F.col("__i"), F.lit(2 * k))
    dealt = numbered(sizes, [F.desc("__n"), F.asc("__g")], "__i", 0).withColumn("fold", F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int")).select("__g", "fold")
    return df.withColumn("__own", group).join(dealt, F.col("__own").eqNullSafe(F.col("__g"))).drop("__own", "__g")


def _turns(rows: list[int], size: int, count: int) -> list[tuple[int, list[int]]]:
    """How the greedy rule deals `count` groups of one size to folds that have so many rows (which it adds to): from the
    first number on, the folds of the list by turns. At most one entry for each fold: each begins when a fold that was too
    full so far joins in."""
    order = sorted(range(len(rows)), key=lambda f: (rows[f], f))
    out, at = [], 0
    for m in range(1, len(order) + 1):
        active = sorted(order[:m], key=lambda f: (rows[f], f))
        if m < len(order):
            joins = order[m]
            # Groups that each fold gets before it comes after the one that joins.
            steps = sum(max(0, (rows[joins] - rows[f]) // size + int((rows[joins] - rows[f]) % size > 0 or f < joins)) for f in active)
        else:
            steps = count - at
        steps = min(steps, count - at)
        if steps:
            out.append((at, active))
            for k, f in enumerate(active):
                rows[f] += size * (steps // m + (k < steps % m))
            at += steps
    return out


def greedy_folds(df: DataFrame, group: Column, k: int) -> DataFrame:
    """The same by the greedy rule: groups by falling size, each to the fold with the fewest rows so far (ties: the
    smallest number). Groups of one size are alike to the rule: the driver sees the histogram of the sizes, no longer than
    the root of twice the rows, and answers with k entries for each size at most."""
    sizes = df.groupBy(group.alias("__g")).agg(F.count("*").alias("__n"))
    rows, plan = [0] * k, []
    for size, count in sizes.groupBy("__n").count().orderBy(F.desc("__n")).collect():
        turns = _turns(rows, size, count)
        plan.append((size, [t for t, _ in turns], [o for _, o in turns]))
    by_size = df.sparkSession.createDataFrame(plan, "__n long, __starts array<long>, __orders array<array<int>>")
    ranked = numbered(sizes, [F.desc("__n"), F.asc("__g")], "__i", 0)
    start = ranked.groupBy("__n").agg(F.min("__i").alias("__first"))
    own = ranked.join(start, "__n").join(by_size, "__n").withColumn("__at", F.col("__i") - F.col("__first"))
    entry = own.withColumn("__e", F.size(F.filter("__starts", lambda s: s <= F.col("__at"))) - 1).select("__g", "__at", F.get("__starts", F.col("__e")).alias("__s"), F.get("__orders", F.col("__e")).alias("__o"))
    dealt = entry.select("__g", F.get("__o", F.pmod(F.col("__at") - F.col("__s"), F.size("__o")).cast("int")).alias("fold"))
    return df.withColumn("__own", group).join(dealt, F.col("__own").eqNullSafe(F.col("__g"))).drop("__own", "__g")


def _balanced(df: DataFrame, label: str) -> DataFrame:
    n = df.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    p, q = max(1, n.p), max(1, n.n - n.p)
    return df.withColumn("__w", F.when(F.col(label) == 1, n.n / (2 * p)).otherwise(n.n / (2 * q)))


def fit_classifier(df: DataFrame, label: str, features: str = "features", c: float = 1.0):
    """Scaler and L2 logistic regression with balanced weights; a function that adds p."""
    scaler = StandardScaler(withMean=True, inputCol=features, outputCol="__scaled").fit(df)
    train = _balanced(scaler.transform(df), label)
    model = LogisticRegression(featuresCol="__scaled", labelCol=label, weightCol="__w", regParam=1.0 / (c * max(1, df.count())), maxIter=50, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__pred").fit(train)
    return lambda rows: model.transform(scaler.transform(rows)).withColumn("p", vector_to_array("__p")[1]).drop("__scaled", "__p", "__raw", "__pred")


def out_of_fold(df: DataFrame, label: str, k: int, features: str = "features", c: float = 1.0) -> DataFrame:
    """Each labelled row's probability from a model that has not seen its fold (column fold)."""
    out = None
    for f in range(k):
        part = fit_classifier(df.where(F.col("fold") != f), label, features, c)(df.where(F.col("fold") == f))
        out = part if out is None else out.unionByName(part)
    return out


def project(df: DataFrame, k: int, features: str = "features", out: str = "reduced", scale: bool = True) -> DataFrame:
    """Principal components of standardised features."""
    if scale:
        df = StandardScaler(withMean=True, inputCol=features, outputCol="__scaled").fit(df).transform(df)
        features = "__scaled"
    return PCA(k=k, inputCol=features, outputCol=out).fit(df).transform(df).drop("__scaled")


def balance_blocks(df: DataFrame, blocks: dict[str, str]) -> DataFrame:
    """Array columns scaled so that each block has a total variance of one. blocks: column, name of the result."""
    for c, out in blocks.items():
        sizes = df.select(F.posexplode(c).alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("v")).agg(F.sum("v")).first()[0] or 1.0
        df = df.withColumn(out, F.transform(F.col(c), lambda x: x / math.sqrt(sizes)))  # noqa: B023
    return df


def mixture_bic(loglik: float, n: int, k: int, d: int) -> float:
    return -2 * loglik + (k - 1 + k * d + k * d * (d + 1) / 2) * math.log(max(1, n))


def fit_mixture(df: DataFrame, ks: Sequence[int], features: str = "features", seeds: Sequence[int] = (1, 2), least_rows: int = 1):
    """(model, k, {k: bic}): best of the seeds for each k by likelihood, best k by BIC. Spark fits two
    groups and more; ks with too few rows are left out."""
    df = df.persist()
    n = df.count()
    found, bic = {}, {}
    for k in (k for k in ks if k > 1 and n >= least_rows * k):
        d = len(df.select(features).first()[0])
        for seed in seeds:
            m = GaussianMixture(k=k, seed=seed, featuresCol=features, probabilityCol="posterior", predictionCol="cluster").fit(df)
            if k not in found or m.summary.logLikelihood > found[k].summary.logLikelihood:
                found[k] = m
        bic[k] = mixture_bic(found[k].summary.logLikelihood, n, k, d)
    df.unpersist()
    if not bic:
        raise ValueError("too few rows for any number of groups")
    best = min(bic, key=lambda k: (bic[k], k))
    return found[best], best, bic


def posterior_stats(rows: DataFrame, scores: Sequence[float], posterior: str = "posterior") -> DataFrame:
    """Most likely group, its probability, and the score averaged over the posterior."""
    p = vector_to_array(posterior)
    mean = F.aggregate(F.zip_with(p, F.array(*(F.lit(float(s)) for s in scores)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.withColumns({"group": F.array_position(p, F.array_max(p)).cast("int") - 1, "group_p": F.array_max(p), "group_score": mean})


def require_rows(df: DataFrame, least: int) -> DataFrame:
    n = df.limit(least).count()
    if n < least:
        raise ValueError(f"{n} rows are too few, {least} are needed")
    return df


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of all rows of x with all of y, summed in the order of `cosine`, so that equal vectors tie."""
    out = np.zeros((len(x), len(y)))
    for d in range(x.shape[1]):
        out += x[:, d, None] * y[None, :, d]
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * x[:, d]
    return np.sqrt(out)


def _cosines(column: pa.ListArray, vectors: list[list | None]) -> np.ma.MaskedArray:
    """Cosine of each row's vector with each query vector; masked where `cosine` is null."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = np.ma.masked_all((len(column), len(vectors)))
    for d in {len(v) for v in vectors if v and None not in v}:
        cols = [j for j, v in enumerate(vectors) if v and None not in v and len(v) == d]
        flat = column.take(pa.array(np.flatnonzero(sizes == d))).flatten()
        whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, d).all(axis=1)
        x, y = flat.to_numpy(zero_copy_only=False).reshape(-1, d).astype(float)[whole], np.array([vectors[j] for j in cols], dtype=float)
        with np.errstate(all="ignore"):
            norm = _norms(x)[:, None] * _norms(y)[None, :]
            out[np.ix_(np.flatnonzero(sizes == d)[whole], cols)] = np.ma.array(_dots(x, y) / norm, mask=norm == 0)
    return out


def _similar(batches: Iterator[pa.RecordBatch], names: list, vectors: list[list | None], k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A task's k most similar rows for each query. batches: key, vector."""
    own: dict = {}
    for j, name in enumerate(names):
        own.setdefault(name, []).append(j)
    asked, rows = np.zeros(0, dtype=int), max(1, 1_000_000 // len(names))
    keys = order = None
    for batch in batches:
        for low in range(0, len(batch), rows):
            part = batch.slice(low, rows)
            new = np.array(part.column(0).to_pylist())
            got = _cosines(part.column(1), vectors)
            # As Spark sorts: NaN above all numbers, null (-2) below; -3 is the query itself.
            o = got.filled(-2.0)
            o[np.isnan(o)] = 3.0
            for i, key in enumerate(new.tolist()):
                o[i, own.get(key, [])] = -3.0
            least = np.partition(o, len(o) - k, axis=0)[len(o) - k] if len(o) > k else np.full(len(names), -2.0)
            i, j = np.nonzero((o >= least) & (o > -3.0))
            asked, keys, order = np.concatenate([asked, j]), new[i] if keys is None else np.concatenate([keys, new[i]]), o[i, j] if order is None else np.concatenate([order, o[i, j]])
            by = np.lexsort((keys, -order, asked))
            first = np.searchsorted(asked[by], np.arange(len(names)))
            by = by[np.arange(len(by)) - first[asked[by]] < k]
            asked, keys, order = asked[by], keys[by], order[by]
    if keys is not None:
        similarity = pa.array(np.where(order == 3.0, np.nan, order), pa.float64(), mask=order == -2.0)
        yield pa.record_batch([pa.array([names[j] for j in asked], schema.field(0).type), pa.array(keys.tolist(), schema.field(1).type), similarity], schema=schema)


def cosine_top(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, max_queries: int = 10_000) -> DataFrame:
    """The k most similar rows for each query vector; ties by key. Queries go to the tasks in blocks of about max_queries."""
    pick = lambda df: df.where(F.col(key).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("__v"))
    left, asked = pick(rows), pick(queries)
    schema = left.select(F.col(key).alias("query"), key, F.lit(None).cast("double").alias("similarity")).schema
    arrow, out = to_arrow_schema(schema), None
    blocks = max(1, -(-asked.count() // max_queries))
    for block in range(blocks):
        q = asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == block).collect()
        if q:
            names, vectors = [x[0] for x in q], [x[1] for x in q]
            top = left.mapInArrow(lambda it, names=names, vectors=vectors: _similar(it, names, vectors, k, arrow), schema)
            rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))
            top = top.withColumn("rank", rank).where(F.col("rank") <= k)
            top = top if blocks == 1 else cut(top, "similar")
            out = top if out is None else out.unionByName(top)
    return left.limit(0).select(F.col(key).alias("query"), key, F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")) if out is None else out


def stability(df: DataFrame, key: str, group: str, k: int, runs: int = 5, share: float = 0.8, features: str = "features") -> DataFrame:
    """Adjusted Rand index of the groups against mixtures fitted again on seeded samples: (run, adjusted_rand)."""
    from fieldloom.operators.aggregates import adjusted_rand

    out = None
    for run in range(runs):
        part = df.where(F.pmod(F.xxhash64(F.col(key), F.lit(run)), F.lit(1000)) < int(1000 * share)).select(key, group, features).persist()
        again = GaussianMixture(k=k, seed=run, featuresCol=features, predictionCol="__again", probabilityCol="__post").fit(part).transform(part)
        one = adjusted_rand(again.select(F.col(group).alias("a"), F.col("__again").alias("b")), "a", "b").withColumn("run", F.lit(run)).select("run", "adjusted_rand")
        out = one if out is None else out.unionByName(one)
    return out


def final_scores(rows: DataFrame, out_of_fold: DataFrame, key: str, score: str = "p") -> DataFrame:
    """rows with the out-of-fold score where a row has one, else with its own."""
    own = out_of_fold.select(F.col(key).alias("__k"), F.col(score).alias("__oof"))
    return rows.join(own, F.col(key) == F.col("__k"), "left").withColumn(score, F.coalesce("__oof", score)).drop("__k", "__oof")


def trained_or_stored(labelled: DataFrame, label: str, least: int, train, stored: str):
    """What train(labelled) returns if each class has at least `least` labelled rows, else the stored pipeline model."""
    counts = [r["count"] for r in labelled.where(F.col(label).isNotNull()).groupBy(label).count().collect()]
    if len(counts) > 1 and min(counts) >= least:
        return train(labelled)
    from pyspark.ml import PipelineModel

    return PipelineModel.load(stored).transform
