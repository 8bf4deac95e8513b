"""Mergers of all points against brute force."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessella import registry
from tessella.operators import agglomeration


def follow(v, mergers, linkage):
    """Asserts that each merger joins two clusters, named as promised, of which no other two are nearer; returns the members of the last."""
    n, rows = len(v), sorted(mergers.collect(), key=lambda r: r["step"])
    assert [r["step"] for r in rows] == list(range(n - 1)) and {r["g"] for r in rows} == {0}
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    d[np.diag_indices(n)] = np.inf
    place, members = {k: k for k in range(n)}, {k: [k] for k in range(n)}
    for r in rows:
        i, j = place.pop(r["first"]), place.pop(r["second"])
        a, b = members.pop(i), members.pop(j)
        assert min(a) < min(b)
        assert r["distance"] == pytest.approx(d[i, j], rel=1e-9, abs=1e-12) == pytest.approx(d.min(), rel=1e-9, abs=1e-12)
        joined = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (len(a) * d[i] + len(b) * d[j]) / (len(a) + len(b))}[linkage]
        joined[[i, j]] = np.inf
        d[i], d[:, i], d[j], d[:, j] = joined, joined, np.inf, np.inf
        place[n + r["step"]], members[i] = i, a + b
    return members.popitem()[1]


def test_query_merges_every_row(spark):
    d = "/root/testdata/sf0.001"
    told = pq.read_table(f"{d}/embeddings.parquet", columns=["vec_id", "embedding"]).sort_by("vec_id")
    v = np.array(told["embedding"].to_pylist(), float)
    assert len(follow(v, registry.queries()["c01_agglomerative"](spark, d), "average")) == len(v) == 500


@pytest.mark.parametrize("linkage", ["average", "single", "complete"])
def test_rounds_windows_and_split_clusters(spark, monkeypatch, linkage):
    # Ten clusters at most in a task, chunks of some 16 points, clusters of more than three points in several.
    monkeypatch.setattr(agglomeration, "CHUNK", 16)
    monkeypatch.setattr(agglomeration, "PART", 3)
    v = np.random.default_rng(11).normal(size=(60, 3)) * 1e-3 + 1e3
    v[10:16], v[30:33], v[50] = v[3], v[5], v[51]  # copies
    df = spark.createDataFrame([(100 - k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    members, mergers = agglomeration.mergers(df, linkage, most=10)
    member = {r["id"]: r["member"] for r in members.collect()}
    assert member == {100 - k: 59 - k for k in range(60)}
    follow(v[::-1], mergers, linkage)


def test_points_at_equal_distances_and_points_without_a_place(spark):
    rows = [(k, [float(k), 0.0]) for k in range(30)] + [(30, None), (31, [0.0, None]), (32, [float("nan"), 0.0]), (33, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    members, mergers = agglomeration.mergers(df, most=8)
    assert members.count() == 30
    follow(np.array([r[1] for r in rows[:30]]), mergers, "average")
    for few in (0, 1):
        members, mergers = agglomeration.mergers(df.limit(few))
        assert members.count() == few and mergers.collect() == []
