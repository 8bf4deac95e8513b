"""Merge hypotheses and biclusters."""

import itertools
import random

import numpy as np
import pytest

from tessella.operators import bispectral, hypotheses


@pytest.mark.parametrize("seed", range(3))
def test_hypotheses_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    volume = {k: rng.choice([1, 2, 3, 50, None]) if k else 1 for k in range(12)}
    edges = {(a, b) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.3}
    listed = [e if rng.random() < 0.5 else e[::-1] for e in edges] + [(0, 0), (3, 99)]
    got = hypotheses.merge_hypotheses(spark.createDataFrame(list(volume.items()), "id long, volume long"), spark.createDataFrame(listed + listed[:3], "source long, target long"), 5, 11.0).collect()

    def connected(s):
        reached, more = set(), {min(s)}
        while more:
            reached |= more
            more = {b for a in more for b in s if (a, b) in edges or (b, a) in edges} - reached
        return reached == set(s)

    there = [k for k, v in volume.items() if v is not None]
    want = sorted((list(s), len(s), float(sum(volume[k] for k in s))) for n in range(1, 6) for s in itertools.combinations(there, n) if sum(volume[k] for k in s) <= 11 and connected(s))
    assert sorted((r["members"], r["size"], r["volume"]) for r in got) == want


def test_no_regions_and_no_edges(spark):
    none = spark.createDataFrame([], "source long, target long")
    assert hypotheses.merge_hypotheses(spark.createDataFrame([], "id long, volume long"), none, 3, 9.0).collect() == []
    assert [tuple(r) for r in hypotheses.merge_hypotheses(spark.createDataFrame([(4, 2)], "id long, volume long"), none, 3, 9.0).collect()] == [([4], 1, 2.0)]


def test_singular_vectors_equal_numpy(spark):
    rng = np.random.default_rng(2)
    a = np.where(rng.random((30, 9)) < 0.7, rng.random((30, 9)), 0)
    entries = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i in range(30) for j in range(9) if a[i, j]], "r int, c int, w double")
    values, left, right = bispectral.singular_vectors(entries, 3, tolerance=1e-9)
    u, s, v = np.linalg.svd(a)
    assert values == pytest.approx(s[:3], rel=1e-5)
    for side, key, exact in ((left, "r", u[:, :3]), (right, "c", v[:3].T)):
        got = np.array([r["v"] for r in side.orderBy(key).collect()])
        assert np.abs(np.abs((got * exact).sum(0)) - 1).max() < 1e-3 and np.allclose((got * got).sum(0), 1, atol=1e-3)


def test_planted_blocks_are_found(spark):
    rng = np.random.default_rng(3)
    block_r, block_c = rng.integers(0, 3, 60), rng.integers(0, 3, 24)
    w = rng.random((60, 24)) * 0.1 + 2.0 * (block_r[:, None] == block_c[None, :])
    entries = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(60) for j in range(24)], "r int, c int, w double")
    rows, columns = bispectral.biclusters(entries, 3)
    found_r, found_c = ({r[key]: r["cluster"] for r in t.collect()} for t, key in ((rows, "r"), (columns, "c")))
    pairs = {(int(block_r[i]), found_r[i]) for i in range(60)} | {(int(block_c[j]), found_c[j]) for j in range(24)}
    assert len(pairs) == 3
