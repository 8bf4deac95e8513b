"""Progression similarity, the one-class margin, and batches by information."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import batchchoice, oneclass, progression


def test_progression_follows_what_is_alike(spark):
    rng = np.random.default_rng(1)
    x = rng.random(200)
    v = np.column_stack([x, 2 * x + 1, x + rng.normal(0, 0.02, 200), rng.random(200), np.full(200, 3.0)])
    got = {(r["context"], r["feature"]): r["score"] for r in progression.similarity(spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(v)], "id long, v array<double>")).collect()}
    assert len(got) == 25
    assert all(got[k, k] == pytest.approx(1.0) for k in range(4))
    assert got[0, 1] == pytest.approx(1.0, abs=0.02) and got[0, 2] > 0.8 and got[0, 3] < 0.3
    assert all(got[4, k] == got[k, 4] == 0 for k in range(5))
    assert progression.similarity(spark.createDataFrame([], "id long, v array<double>")).collect() == []


def exact_margin(x, nu, gamma, rounds=4000):
    """Scores of the kernel's own margin, by conditional gradients over the rows' weights."""
    z = (x - x.mean(0)) / x.std(0)
    kernel = np.exp(-gamma * ((z[:, None, :] - z[None, :, :]) ** 2).sum(2))
    n = len(x)
    a = np.full(n, 1 / n)
    for _ in range(rounds):
        s = kernel @ a
        order, aim = np.argsort(s, kind="stable"), np.zeros(n)
        full = int(nu * n)
        aim[order[:full]] = 1 / (nu * n)
        aim[order[full]] += 1 - aim.sum()
        way = a - aim
        gap = s @ way
        if gap < 1e-9:
            break
        a = a - min(1.0, gap / (way @ kernel @ way)) * way
    return kernel @ a


def test_one_class_margin_agrees_with_the_kernel(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (150, 3)), rng.normal(6, 0.7, (130, 3)), rng.uniform(-8, 14, (20, 3))])
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "id long, v array<double>").withColumn("v", F.when(F.col("id") >= 0, F.col("v")))
    model = oneclass.fit(df, nu=0.1, size=512, gamma=0.5, rounds=30)
    got = oneclass.score(df, model).orderBy("id").collect()
    assert 0.07 <= np.mean([r["outlier"] for r in got]) <= 0.13
    ours, exact = (np.argsort(np.argsort(s)) for s in ([r["score"] for r in got], exact_margin(x, 0.1, 0.5)))
    assert np.corrcoef(ours, exact)[0, 1] > 0.9
    lowest = set(np.argsort(ours)[:30])
    assert len(lowest & set(np.argsort(exact)[:30])) >= 24 and len(lowest & set(range(280, 300))) >= 17


def test_one_class_without_rows_or_spread(spark):
    none = spark.createDataFrame([(1, None)], "id long, v array<double>")
    with pytest.raises(ValueError, match="features"):
        oneclass.fit(none)
    same = spark.createDataFrame([(k, [2.0, 3.0]) for k in range(20)] + [(99, None)], "id long, v array<double>")
    assert oneclass.score(same, oneclass.fit(same, size=16)).count() == 20


def plain_greedy(x, u, k):
    inverse, out = np.eye(x.shape[1]), []
    for _ in range(min(k, len(x))):
        gain = np.log1p(u * np.einsum("ij,jk,ik->i", x, inverse, x))
        gain[[i for i, _ in out]] = -np.inf
        at = int(np.flatnonzero(gain >= gain.max() - 1e-12)[0])
        out.append((at, gain[at]))
        side = inverse @ x[at]
        inverse = inverse - np.outer(side, side) * (u[at] / (1 + u[at] * (x[at] @ side)))
    return out


@pytest.mark.parametrize("ahead", [1, 5, 1000])
def test_batch_equals_plain_greedy(spark, ahead):
    rng = np.random.default_rng(4)
    x, u = rng.normal(size=(60, 4)), rng.random(60)
    x[10:20], u[10:20] = x[3], u[3]  # ties
    rows = spark.createDataFrame([(k, x[k].tolist(), float(u[k])) for k in range(60)] + [(70, None, 1.0), (71, [1.0] * 4, None)], "id long, v array<double>, u double")
    got = batchchoice.informative_batch(rows, 5, ahead).orderBy("rank").collect()
    want = plain_greedy(x, u, 5)
    assert [r["id"] for r in got] == [i for i, _ in want]
    assert [r["gain"] for r in got] == pytest.approx([g for _, g in want])


def test_batch_of_few_or_no_rows(spark):
    rows = spark.createDataFrame([(1, [1.0], 0.5), (2, [2.0], 0.5)], "id long, v array<double>, u double")
    assert [r["id"] for r in batchchoice.informative_batch(rows, 9).collect()] == [2, 1]
    assert batchchoice.informative_batch(rows.limit(0), 3).collect() == []
