"""Gaussian mixtures against a plain sequential version."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import mixtures


def three(n=600, seed=3):
    rng = np.random.default_rng(seed)
    parts = [rng.multivariate_normal(m, c, n // 3) for m, c in (((0, 0), ((1, 0.6), (0.6, 1))), ((8, 1), ((0.5, 0), (0, 2))), ((3, 9), ((1.5, -0.4), (-0.4, 0.5))))]
    return np.concatenate(parts) * [1.0, 100.0] + [5.0, -2000.0]


def frame(spark, x, parts=4):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>").repartition(parts)


def plain(x, k, ridge, begin, rounds):
    """Row by row, with inverses and determinants."""
    w, mu, cov = list(begin.weights), list(begin.means), list(begin.covariances)
    n, d = x.shape
    for turn in range(rounds):
        r, loglik = np.zeros((n, k)), 0.0
        for i in range(n):
            p = [w[j] * math.exp(-0.5 * (x[i] - mu[j]) @ np.linalg.inv(cov[j]) @ (x[i] - mu[j])) / math.sqrt((2 * math.pi) ** d * np.linalg.det(cov[j])) for j in range(k)]
            loglik += math.log(sum(p))
            r[i] = np.array(p) / sum(p)
        if turn == rounds - 1:
            return np.array(w), np.array(mu), np.array(cov), loglik
        for j in range(k):
            w[j] = r[:, j].sum() / n
            mu[j] = (r[:, j, None] * x).sum(axis=0) / r[:, j].sum()
            cov[j] = sum(r[i, j] * np.outer(x[i] - mu[j], x[i] - mu[j]) for i in range(n)) / r[:, j].sum() + ridge * np.eye(d)


def test_equals_plain_version(spark):
    x = three(150)
    got, _ = mixtures.fit(frame(spark, x), [3], seeds=(7,), rounds=6, tolerance=-1.0, ridge=1e-4)
    shift, scale = x.mean(axis=0), x.std(axis=0)
    sample = (mixtures._sample(frame(spark, x, 3).select(F.col("features").alias("x")), 1000) - shift) / scale
    w, mu, cov, loglik = plain((x - shift) / scale, 3, 1e-4, mixtures.start(sample, 3, 7, 1e-4), 6)
    assert got.rounds == 6 and got.rows == 150
    assert np.allclose(got.weights, w, atol=1e-9)
    assert np.allclose(got.means, mu * scale + shift, rtol=1e-9)
    assert np.allclose(got.covariances, cov * np.outer(scale, scale), rtol=1e-7)
    assert got.loglik == pytest.approx(loglik - len(x) * np.log(scale).sum(), rel=1e-10)


def test_bic_finds_three_groups_and_one(spark):
    x = three()
    model, bic = mixtures.fit(frame(spark, x), [1, 2, 3, 4])
    assert model.k == 3 and set(bic) == {1, 2, 3, 4}
    assert sorted(np.round(model.weights, 1)) == [0.3, 0.3, 0.3]
    out = mixtures.assign(frame(spark, x), model).orderBy("id").collect()
    blocks = [{r["group"] for r in out[low + 5 : low + 200 : 7]} for low in (0, 200, 400)]
    assert all(len(b) == 1 for b in blocks) and len(set.union(*blocks)) == 3
    assert all(abs(sum(r.posterior) - 1) < 1e-12 and r.group_p == max(r.posterior) for r in out)
    one = np.random.default_rng(1).normal(size=(400, 2))
    model, _ = mixtures.fit(frame(spark, one), [1, 2, 3])
    assert model.k == 1
    assert np.allclose(model.means[0], one.mean(axis=0)) and np.allclose(model.covariances[0], np.cov(one.T, bias=True), atol=1e-5)


def test_order_and_partitions_do_not_matter(spark):
    x = three(300)
    a, _ = mixtures.fit(frame(spark, x, 1), [3], rounds=20)
    b, _ = mixtures.fit(frame(spark, x[::-1], 7), [3], rounds=20)
    assert np.allclose(a.means, b.means, rtol=1e-6) and a.loglik == pytest.approx(b.loglik, rel=1e-8)


def test_odd_rows(spark):
    rows = [(0, None), (1, [1.0]), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [])]
    odd = spark.createDataFrame(rows, "id long, features array<double>")
    x = three(90)
    whole = frame(spark, x).withColumn("id", F.col("id") + 10)
    model, _ = mixtures.fit(whole.unionByName(odd), [2])
    assert model.rows == 90
    out = {r.id: r for r in mixtures.assign(whole.unionByName(odd), model).collect()}
    assert len(out) == 96
    assert all((r["group"] is None and r.posterior is None and r.group_p is None) == (i < 10) for i, r in out.items())


def test_repeated_rows_constant_columns_and_few_rows(spark):
    same = spark.createDataFrame([(i, [2.0, float(i % 2)]) for i in range(40)], "id long, features array<double>")
    model, _ = mixtures.fit(same, [1, 2])
    assert np.allclose(model.means[:, 0], 2.0) and math.isfinite(model.loglik)
    with pytest.raises(ValueError, match="too few"):
        mixtures.fit(same, [5], least_rows=10)
    with pytest.raises(ValueError, match="too few"):
        mixtures.fit(same.limit(0), [1])
    assert mixtures.assign(same.limit(0), model).count() == 0


def test_stability(spark):
    df = frame(spark, three(240))
    model, _ = mixtures.fit(df, [3])
    got = mixtures.stability(df, "id", model, runs=2, rounds=30).collect()
    assert [r.run for r in sorted(got)] == [0, 1]
    assert all(150 < r["rows"] < 230 and r.adjusted_rand > 0.9 for r in got)
