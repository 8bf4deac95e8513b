"""Volume series, gap statistic, assignment of tracks, convex hulls."""

import itertools
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import assignment, gapstat, hull
from tessella.sources import volumes


def series(spark, kind=lambda v: v):
    cells = [(t, ch, z, y, x, kind((t * 7 + ch * 5 + z * 3 + y * 2 + x) % 200)) for t in range(3) for ch in range(2) for z in range(7) for y in range(4) for x in range(5)]
    return cells, spark.createDataFrame(cells, "t int, ch int, z int, y int, x int, value double" if isinstance(cells[0][5], float) else "t int, ch int, z int, y int, x int, value int")


@pytest.mark.parametrize(("kind", "type"), [(int, "uint8"), (lambda v: v - 100, "int16"), (lambda v: v / 4, "float32"), (lambda v: v / 3, "float64")])
def test_volume_series_come_back(spark, tmp_path, kind, type):
    cells, df = series(spark, kind)
    path = volumes.write(df, str(tmp_path / "s"), type, slab_bytes=8 * 20 * 3)
    got = volumes.read(spark, path, slab_bytes=20 * 2 * np.dtype(type).itemsize)
    assert sorted(map(tuple, got.collect())) == sorted(cells)
    one = volumes.read(spark, str(tmp_path / "s" / "time_1.xml"))
    assert sorted(map(tuple, one.collect())) == sorted(c for c in cells if c[0] == 1)


def test_a_partition_for_each_slab_and_filters_leave_files_out(spark, tmp_path):
    _, df = series(spark, int)
    path = volumes.write(df, str(tmp_path / "s"), "uint8", slab_bytes=8 * 20 * 3)
    slabs = volumes.slabs(path, 20 * 2)
    assert sorted((s.t, s.ch, s.z, s.depth) for s in slabs) == sorted((t, ch, z, d) for t in range(3) for ch in range(2) for z, d in ((0, 2), (2, 1), (3, 2), (5, 1), (6, 1)))
    whole = volumes.read(spark, path, 20 * 2)
    assert whole.rdd.getNumPartitions() == len(slabs)
    for where, left in (("t = 1", 10), ("t in (0, 2) and ch = 1", 10), ("z > 5", 6), ("z <= 1 and t >= 2", 2), ("t = 9", 1), ("x = 2", 30)):
        assert whole.where(where).rdd.getNumPartitions() == left, where
        assert whole.where(where).count() == df.where(where).count()
    # A filtered read never opens the other files.
    for f in os.listdir(tmp_path / "s"):
        if f.startswith("t_0_"):
            os.remove(tmp_path / "s" / f)
    assert whole.where("t = 1").count() == 280


def test_gaps_become_zero_and_bad_values_fail(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1, 1, 2, 7), (0, 0, 3, 0, 0, 9)], "t int, ch int, z int, y int, x int, value int")
    got = {tuple(r)[2:] for r in volumes.read(spark, volumes.write(df, str(tmp_path / "a"))).collect()}
    assert got == {(z, y, x, {(1, 1, 2): 7.0, (3, 0, 0): 9.0}.get((z, y, x), 0.0)) for z in range(4) for y in range(2) for x in range(3)}
    assert volumes.read(spark, volumes.write(df.limit(0), str(tmp_path / "empty"))).count() == 0
    for bad in (df.withColumn("value", F.lit(1e9)), df.withColumn("value", F.lit(0.5)), df.withColumn("z", F.lit(-1))):
        with pytest.raises(Exception, match="fit|begin"):
            volumes.write(bad, str(tmp_path / "bad"))
    assert not (tmp_path / "bad" / "series.xml").exists()


def blobs(spark, centres, n=60):
    rng = np.random.default_rng(5)
    rows = [(k, (np.array(centres[k % len(centres)]) + rng.normal(0, 0.3, 2)).tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "id long, v array<double>")


@pytest.mark.parametrize("centres", [[(0, 0), (10, 0)], [(0, 0), (10, 0), (0, 12)]])
def test_gap_statistic_finds_the_blobs(spark, centres):
    got = gapstat.gap_statistic(blobs(spark, centres), most=6, references=8).orderBy("k").collect()
    assert [r["k"] for r in got] == [1, 2, 3, 4, 5, 6] and [r["k"] for r in got if r["chosen"]] == [len(centres)]
    assert all(r["s"] > 0 and r["gap"] == pytest.approx(r["expected"] - r["log_w"]) for r in got)


def test_gap_statistic_of_the_data_is_its_scatter(spark):
    df = blobs(spark, [(0, 0), (10, 0)])
    x = np.array([r["v"] for r in df.collect()])
    got = {r["k"]: r["log_w"] for r in gapstat.gap_statistic(df, most=2, references=3).collect()}
    halves = [x[x[:, 0] < 5], x[x[:, 0] > 5]]
    assert got[1] == pytest.approx(np.log(((x - x.mean(0)) ** 2).sum()))
    assert got[2] == pytest.approx(np.log(sum(((h - h.mean(0)) ** 2).sum() for h in halves)))
    assert gapstat.gap_statistic(df.limit(0)).collect() == []
    assert gapstat.gap_statistic(df.limit(2), most=5, references=2).count() == 2


def test_references_fill_the_box_and_differ():
    u = gapstat.uniform(np.arange(20000, dtype=np.uint64), 1, 3, 7)
    v = gapstat.uniform(np.arange(20000, dtype=np.uint64), 2, 3, 7)
    assert (0 <= u).all() and (u < 1).all() and np.abs(u.mean(0) - 0.5).max() < 0.01 and np.abs(np.corrcoef(u.T)[0, 1]) < 0.03
    assert np.abs(np.corrcoef(u[:, 0], v[:, 0])[0, 1]) < 0.03


def best_total(worth):
    """Most that pairs of a dictionary (row, column) -> worth can be worth, each row and column once at most."""
    rows = sorted({a for a, _ in worth})
    columns = sorted({b for _, b in worth})
    best = {0: 0.0}
    for a in rows:
        fresh = dict(best)
        for used, total in best.items():
            for k, b in enumerate(columns):
                if (a, b) in worth and not used >> k & 1:
                    fresh[used | 1 << k] = max(fresh.get(used | 1 << k, 0.0), total + worth[a, b])
        best = fresh
    return max(best.values())


@pytest.mark.parametrize("seed", range(2))
def test_auction_is_worth_as_much_as_the_best_assignment(spark, seed):
    rng = random.Random(seed)
    rows = [(t, 100 * t + k, rng.uniform(0, 3), rng.uniform(0, 3), 0.0) for t in range(4) for k in range(7)]
    pairs = assignment.candidates(spark.createDataFrame(rows, "t int, id long, x double, y double, z double"), 1.5)
    want = {(a[0], a[1], b[0], b[1]): 1.5 - np.hypot(a[2] - b[2], a[3] - b[3]) for a in rows for b in rows if b[0] == a[0] + 1 and np.hypot(a[2] - b[2], a[3] - b[3]) <= 1.5}
    assert {tuple(r)[:4]: r["worth"] for r in pairs.collect()} == pytest.approx(want)
    got = assignment.auction(pairs, 0.002).collect()
    for t in range(3):
        own = [r for r in got if r["t"] == t]
        assert len({r["id"] for r in own}) == len({r["id2"] for r in own}) == len(own)
        assert sum(r["worth"] for r in own) >= best_total({(k[1], k[3]): w for k, w in want.items() if k[0] == t}) - 7 * 0.002


def test_greedy_pairs_are_undone_where_others_are_worth_more(spark):
    # 1 is nearest to 11, but 2 has no other choice.
    rows = [(0, 1, 0.0, 0.0, 0.0), (0, 2, 1.9, 0.0, 0.0), (1, 11, 0.2, 0.0, 0.0), (1, 12, -0.4, 0.0, 0.0)]
    got = assignment.track_events(spark.createDataFrame(rows, "t int, id long, x double, y double, z double"), 2.0).collect()
    assert sorted((r["id"], r["id2"], r["event"]) for r in got) == [(1, 12, "move"), (2, 11, "move")]


def test_objects_appear_disappear_merge_and_split(spark):
    rows = [(0, 1, 0.0, 0.0, 0.0), (0, 2, 10.0, 0.0, 0.0), (0, 3, 10.5, 0.0, 0.0), (0, 4, 50.0, 0.0, 0.0), (1, 11, 0.1, 0.0, 0.0), (1, 12, -0.3, 0.0, 0.0), (1, 13, 10.1, 0.0, 0.0), (1, 14, 90.0, 0.0, 0.0)]
    got = assignment.track_events(spark.createDataFrame(rows, "t int, id long, x double, y double, z double"), 2.0).collect()
    want = [(0, 1, 1, 11, "move"), (0, 1, 1, 12, "split"), (0, 2, 1, 13, "move"), (0, 3, 1, 13, "merge"), (0, 4, 1, None, "disappear"), (0, None, 1, 14, "appear")]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert assignment.track_events(spark.createDataFrame(rows[:4], "t int, id long, x double, y double, z double"), 2.0).collect() == []


def brute_volume(p):
    """Volume of a hull from all triples that have every point on one side."""
    p = np.unique(p, axis=0)
    middle, total, seen = p.mean(0), 0.0, set()
    for i, j, k in itertools.combinations(range(len(p)), 3):
        n = np.cross(p[j] - p[i], p[k] - p[i])
        side = (p - p[i]) @ n
        if n.any() and ((side <= 0).all() or (side >= 0).all()) and (on := tuple(np.flatnonzero(side == 0))) not in seen:
            seen.add(on)
            q, n = p[list(on)].astype(float), n / np.linalg.norm(n)
            u = (q[1] - q[0]) / np.linalg.norm(q[1] - q[0])
            flat = np.column_stack([q @ u, q @ np.cross(n, u)])
            turn = np.argsort(np.arctan2(*(flat - flat.mean(0)).T[::-1]))
            # The outline of a face: corners only, by angles about each point.
            outline = hull.flat_hull(np.round(flat[turn] * 1e6).astype(np.int64)) / 1e6
            area = 0.5 * abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(outline, np.roll(outline, -1, axis=0), strict=True)))
            total += area * abs((q[0] - middle) @ n) / 3
    return total


@pytest.mark.parametrize("seed", range(12))
def test_hull_volume_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    p = rng.integers(0, rng.integers(2, 6), (rng.integers(4, 14), 3))
    assert hull.hull_size(p)[0] == pytest.approx(brute_volume(p), abs=1e-3)


def test_hull_of_box_corners_and_points_on_faces():
    p = np.argwhere(np.ones((4, 3, 6)))
    volume, area, corners = hull.hull_size(p)
    assert (volume, corners) == (30.0, 8) and area == pytest.approx(2 * (6 + 15 + 10))


def test_convexity_of_objects(spark):
    z, y, x = np.indices((17, 17, 17)) - 8
    shapes = {1: (abs(z) < 3) & (abs(y) < 2) & (abs(x) < 4), 2: z * z + y * y + x * x <= 40, 3: (z == 0) & (y == 0), 4: (z == 0) & (abs(y) < 5) & (abs(x) < 5) & ((abs(y) > 3) | (abs(x) > 3))}
    rows = [(k, 0, 0, *map(int, p)) for k, m in shapes.items() for p in np.argwhere(m)] + [(0, 0, 0, 0, 0, 0)]
    got = {r["label"]: r for r in hull.convexity(spark.createDataFrame(rows, "label int, t int, ch int, z int, y int, x int")).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1]["convexity"] == got[3]["convexity"] == 1.0 and got[4]["hull_volume"] == 81 and got[4]["volume"] == 32
    corners = np.array(list(itertools.product((0, 1), repeat=3)))
    whole = (np.argwhere(shapes[2])[:, None, :] + corners).reshape(-1, 3)
    assert got[2]["hull_volume"] == pytest.approx(hull.hull_size(whole)[0]) and 0.8 < got[2]["convexity"] < 1


def test_auction_in_a_task_is_that_of_rounds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(t, int(a), t + 1, int(b), float(w)) for t in range(2) for a in range(12) for b, w in zip(rng.permutation(15)[:6], rng.integers(1, 9, 6) / 8, strict=True)]
    pairs = spark.createDataFrame(rows, "t int, id long, t2 int, id2 long, worth double")
    whole = sorted(map(tuple, assignment.auction(pairs, 0.125).collect()))
    monkeypatch.setattr(assignment, "MOST", 0)
    assert whole == sorted(map(tuple, assignment.auction(pairs, 0.125).collect())) and len(whole) > 15


def test_an_auction_of_many_rounds_ends_soon(spark):
    # Eight objects raise the prices of seven places by a step a bid: hundreds of rounds, a second and more each by joins.
    pairs = spark.createDataFrame([(0, a, 1, b, 1.0) for a in range(8) for b in range(7)], "t int, id long, t2 int, id2 long, worth double")
    start = time.monotonic()
    assert assignment.auction(pairs, 0.002).count() == 7 and time.monotonic() - start < 60
