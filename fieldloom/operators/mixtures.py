"""Gaussian mixtures with full covariances: expectation and maximisation from partial sums of each task.

All candidates (numbers of groups and seeds) advance in the same job: a round reads the stored vectors once, each task
adds up what its rows give to every candidate that still moves, and Spark adds up the tasks. The driver only sees those
sums, whose number depends on groups and dimensions and not on rows. Vectors are standardised for the fit, so `ridge`,
added to the diagonal of every covariance, is a share of each column's own variance.

Defined cases: a row whose vector is null, of another length than most, or has a part that is null, NaN or infinite takes
no part in the fit and gets no group; repeated rows count as often as they occur; a column without variance is
left unscaled; too few rows for every k raise ValueError, as does an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.aggregates import adjusted_rand
from fieldloom.sources.store import cut, drop

#: Rows of a batch that are judged at once.
ROWS = 1 << 15


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    loglik: float = math.nan
    rows: int = 0
    rounds: int = 0

    @property
    def k(self) -> int:
        return len(self.weights)

    @property
    def bic(self) -> float:
        d = self.means.shape[1]
        return -2 * self.loglik + (self.k - 1 + self.k * d + self.k * d * (d + 1) / 2) * math.log(max(1, self.rows))

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """For each row and group: log of the group's weight times its density at the row."""
        out = np.empty((len(x), self.k))
        for j, root in enumerate(np.linalg.cholesky(self.covariances)):
            z = np.linalg.solve(root, (x - self.means[j]).T)
            out[:, j] = math.log(self.weights[j]) - np.log(np.diag(root)).sum() - 0.5 * (x.shape[1] * math.log(2 * math.pi) + np.einsum("ij,ij->j", z, z))
        return out

    def posterior(self, x: np.ndarray) -> np.ndarray:
        joint = self.log_joint(x)
        p = np.exp(joint - joint.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _sums(batches: Iterator[pa.RecordBatch], models: dict[int, Mixture], shift: np.ndarray, scale: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a task's rows add to each model: likelihood, and for each group its weight, deviations from its mean and
    their products."""
    d = len(shift)
    held = {m: [0.0, np.zeros(g.k), np.zeros((g.k, d)), np.zeros((g.k, d, d))] for m, g in models.items()}
    for batch in batches:
        whole = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        for low in range(0, len(whole), ROWS):
            x = (whole[low : low + ROWS] - shift) / scale
            for m, g in models.items():
                joint = g.log_joint(x)
                top = joint.max(axis=1)
                total = top + np.log(np.exp(joint - top[:, None]).sum(axis=1))
                share, own = np.exp(joint - total[:, None]), held[m]
                own[0] += total.sum()
                own[1] += share.sum(axis=0)
                for j in range(g.k):
                    away = x - g.means[j]
                    weighted = away * share[:, j, None]
                    own[2][j] += weighted.sum(axis=0)
                    own[3][j] += weighted.T @ away
    for m, parts in held.items():
        flat = np.concatenate([np.ravel(p) for p in parts])
        yield pa.record_batch([pa.array(np.full(len(flat), m, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["model", "at", "value"])


def _moved(g: Mixture, flat: np.ndarray, n: int, ridge: float) -> Mixture:
    """The model that its sums ask for. A group that hardly any row belongs to stays where it is."""
    k, d = g.means.shape
    weight, first, second = flat[1 : 1 + k], flat[1 + k : 1 + k + k * d].reshape(k, d), flat[1 + k + k * d :].reshape(k, d, d)
    weights, means, covariances = np.maximum(weight / n, 1e-12), g.means.copy(), g.covariances.copy()
    for j in np.flatnonzero(weight > 1e-9 * n):
        step = first[j] / weight[j]
        means[j] = g.means[j] + step
        spread = second[j] / weight[j] - np.outer(step, step)
        covariances[j] = (spread + spread.T) / 2 + ridge * np.eye(d)
    return Mixture(weights / weights.sum(), means, covariances)


def start(sample: np.ndarray, k: int, seed: int, ridge: float) -> Mixture:
    """Means far apart, drawn from a sample of standardised rows (each next one by its squared distance from the nearest
    so far); every covariance is that of the sample."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    means = [sample.mean(axis=0)] if k == 1 else [sample[rng.integers(len(sample))]]
    while len(means) < k:
        far = np.min([((sample - m) ** 2).sum(axis=1) for m in means], axis=0)
        means.append(sample[rng.choice(len(sample), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(sample))])
    spread = np.cov(sample.T, bias=True).reshape(d, d) + ridge * np.eye(d)
    return Mixture(np.full(k, 1 / k), np.array(means), np.repeat(spread[None], k, axis=0))


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """Different vectors with the smallest hashes, the same ones however the rows are partitioned."""
    hashed = rows.select(F.xxhash64("x").alias("h"), "x")

    def least(batches):
        kept = None
        for part in batches:
            part = part if kept is None else pd.concat([kept, part])
            kept = part.drop_duplicates("h").nsmallest(most, "h")
        if kept is not None:
            yield kept

    found = hashed.mapInPandas(least, hashed.schema).groupBy("h").agg(F.any_value("x").alias("x")).orderBy("h").limit(most).collect()
    return np.array([r.x for r in found], dtype=float)


def _whole(x: Column, d: int) -> Column:
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(x) == d) & finite, F.lit(False))


def fit(df: DataFrame, ks: Sequence[int], features: str = "features", seeds: Sequence[int] = (1, 2), least_rows: int = 1, rounds: int = 100, tolerance: float = 1e-5, ridge: float = 1e-6, start_rows: int = 1000) -> tuple[Mixture, dict[int, float]]:
    """The best mixture and the BIC of each k: of the seeds the likeliest, of the ks (one is allowed) the one with the least
    BIC. ks with fewer than least_rows rows a group are left out. A candidate stops when a round gains less than
    `tolerance` a row, or after so many rounds. The starting means come from at most start_rows different rows."""
    x = F.col(features).cast("array<double>")
    sizes = df.where(F.size(x) > 0).groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 1
    rows = cut(df.select(x.alias("x")).where(_whole(F.col("x"), d)), "vectors")
    about = rows.agg(F.count("*"), *(f(F.get("x", F.lit(i))) for i in range(d) for f in (F.avg, F.stddev_pop))).first()
    n = about[0]
    ks = sorted({k for k in ks if k >= 1 and n >= max(1, least_rows) * k})
    if not ks:
        drop(rows)
        raise ValueError("too few rows for any number of groups")
    shift, scale = np.array(about[1::2]), np.array(about[2::2])
    scale = np.where(scale > 0, scale, 1.0)
    sample = (_sample(rows, start_rows) - shift) / scale
    names = [(k, seed) for k in ks for seed in (seeds if k > 1 else seeds[:1])]
    moving = {i: start(sample, *name, ridge) for i, name in enumerate(names)}
    last, done = dict.fromkeys(moving, -math.inf), {}
    for turn in range(1, rounds + 1):
        held = dict(moving)
        parts = rows.mapInArrow(lambda it, held=held: _sums(it, held, shift, scale), "model int, at int, value double")
        sums: dict[int, dict[int, float]] = {i: {} for i in held}
        for r in parts.groupBy("model", "at").agg(F.sum("value").alias("value")).collect():
            sums[r.model][r["at"]] = r.value
        for i, g in held.items():
            flat = np.array([sums[i][j] for j in range(len(sums[i]))])
            if turn == rounds or flat[0] - last[i] <= tolerance * n:
                spread = g.covariances * np.outer(scale, scale)
                done[i] = Mixture(g.weights, g.means * scale + shift, spread, flat[0] - n * float(np.log(scale).sum()), n, turn)
                del moving[i]
            else:
                last[i], moving[i] = flat[0], _moved(g, flat, n, ridge)
        if not moving:
            break
    drop(rows)
    best = {k: max((done[i] for i, name in enumerate(names) if name[0] == k), key=lambda g: g.loglik) for k in ks}
    bic = {k: g.bic for k, g in best.items()}
    return best[min(bic, key=lambda k: (bic[k], k))], bic


def assign(df: DataFrame, model: Mixture, features: str = "features") -> DataFrame:
    """df with posterior (a probability for each group), group (the likeliest, ties: the smallest number) and group_p."""
    d = model.means.shape[1]

    @F.pandas_udf("array<double>")
    def posterior(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        return pd.Series(list(model.posterior(np.stack(column.to_list()))))

    x = F.col(features).cast("array<double>")
    # The function gets whole vectors only: another row is judged as the first mean and the answer thrown away.
    known, other = _whole(x, d), F.array(*(F.lit(float(v)) for v in model.means[0]))
    out = df.withColumn("__known", known).withColumn("__p", posterior(F.when(F.col("__known"), x).otherwise(other)))
    out = out.withColumn("posterior", F.when(F.col("__known"), F.col("__p"))).drop("__p", "__known")
    return out.withColumns({"group": F.array_position("posterior", F.array_max("posterior")).cast("int") - 1, "group_p": F.array_max("posterior")})


def stability(df: DataFrame, key: str, model: Mixture, features: str = "features", runs: int = 5, share: float = 0.8, **options) -> DataFrame:
    """(run, rows, adjusted_rand): how well the model's groups agree with those of mixtures of the same size, fitted again
    on samples that a hash of the key chooses. options go to fit()."""
    out = None
    for run in range(runs):
        part = df.where(F.pmod(F.xxhash64(F.col(key), F.lit(run)), F.lit(10_000)) < round(10_000 * share)).select(key, features)
        again, _ = fit(part, [model.k], features, **({"seeds": (run,)} | options))
        both = assign(assign(part, model, features).withColumnRenamed("group", "__own"), again, features).where("group IS NOT NULL")
        one = adjusted_rand(both.select(F.col("__own").alias("a"), F.col("group").alias("b")), "a", "b").select(F.lit(run).alias("run"), F.lit(again.rows).alias("rows"), "adjusted_rand")
        out = one if out is None else out.unionByName(one)
    return out
