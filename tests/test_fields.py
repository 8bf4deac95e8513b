"""Distance maps, holes, the tree of cells, trees between components, and ways in trees."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import celltree, distance, graph, spatial


def image(rng, shape, missing, share):
    return [(0, 0, z, y, x, int(rng.random() < share)) for z in range(shape[0]) for y in range(shape[1]) for x in range(shape[2]) if rng.random() >= missing]


@pytest.mark.parametrize(("shape", "missing", "share"), [((4, 6, 7), 0.0, 0.1), ((5, 4, 9), 0.4, 0.15), ((1, 1, 30), 0.0, 0.1), ((3, 1, 5), 0.2, 0.0)])
def test_distance_map_equals_all_pairs(spark, shape, missing, share):
    rows = image(random.Random(str(shape)), shape, missing, share)
    got = distance.distance_map(spark.createDataFrame(rows, "t int, ch int, z int, y int, x int, site int"), F.col("site") == 1, (2.0, 1.0, 0.5))
    assert got.columns == ["t", "ch", "z", "y", "x", "site", "distance2"]
    sites = [r for r in rows if r[5]]
    want = {r[:5]: min((4 * (r[2] - s[2]) ** 2 + (r[3] - s[3]) ** 2 + (r[4] - s[4]) ** 2 / 4 for s in sites), default=None) for r in rows}
    assert {tuple(r)[:5]: r["distance2"] for r in got.collect()} == want


def test_distance_map_keeps_times_apart_and_bears_long_lines(spark):
    n = 1_000_000
    line = spark.range(n).select(F.lit(0).alias("t"), F.lit(0).alias("ch"), F.lit(0).alias("z"), F.lit(0).alias("y"), F.col("id").alias("x"), F.col("id").isin(0, 700_000).alias("site"))
    other = line.limit(0).unionByName(spark.range(3).select(F.lit(1).alias("t"), F.lit(0).alias("ch"), F.lit(0).alias("z"), F.lit(0).alias("y"), F.col("id").alias("x"), F.lit(False).alias("site")))
    got = distance.distance_map(line.unionByName(other), F.col("site"))
    want = F.when(F.col("t") == 0, F.pow(F.least("x", F.abs(F.col("x") - 700_000)).cast("double"), F.lit(2.0)))
    assert got.where(~F.col("distance2").eqNullSafe(want)).isEmpty() and got.count() == n + 3
    assert distance.distance_map(line.limit(0), F.col("site")).collect() == []


def test_holes_go_to_the_object_about_them(spark):
    cells = {(y, x): 1 for y in range(7) for x in range(7)}
    cells |= {(y, x): 0 for y in (0, 6) for x in range(7)} | {(y, x): 0 for y in range(7) for x in (0, 6)}
    cells[3, 3] = cells[3, 2] = 0  # a hole
    cells[1, 4] = 0  # open to the border
    cells[5, 5] = 2
    cells[4, 5] = 0  # between both objects, more of 1
    cells[5, 6] = 1  # closes the way out
    cells[4, 6] = 1
    rows = [(0, 0, 0, y, x, v) for (y, x), v in cells.items()]
    # One plane has no inside along z: three planes, full above and below.
    rows += [(0, 0, z, y, x, 1 if 0 < y < 6 and 0 < x < 7 else 0) for z in (-1, 1) for y in range(7) for x in range(7)]
    got = {(r["y"], r["x"]): r["label"] for r in distance.fill_holes(spark.createDataFrame(rows, "t int, ch int, z int, y int, x int, label int")).collect() if r["z"] == 0}
    want = cells | {(3, 3): 1, (3, 2): 1, (4, 5): 1}
    assert got == want


def cloud(n, at, seed, first):
    x = np.random.default_rng(seed).random((n, 3)) + at
    return [(first + k, *map(float, p)) for k, p in enumerate(x)]


def brute_nearest(sources, targets, k):
    out = {}
    t = np.array([r[1:4] for r in targets])
    ids = np.array([r[0] for r in targets])
    for s in sources:
        d = np.sqrt(((t - s[1:4]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != s[0]][:k]
        out[s[0]] = [(int(ids[j]), r + 1) for r, j in enumerate(order)]
    return out


POINT = "id long, x double, y double, z double"


@pytest.mark.parametrize("k", [1, 3])
def test_tree_of_cells_finds_the_nearest(spark, k):
    targets = cloud(300, 0, 1, 0) + cloud(300, (1e6, 0, 0), 2, 1000) + [(5000 + j, 3.0, 3.0, 3.0) for j in range(100)] + [(9000, -1e9, 0.0, 0.0)]
    sources = targets[::7] + cloud(50, (5e5, 9, 9), 3, 20000)
    t, s = (spark.createDataFrame(x, POINT).withColumns({"_by": F.lit(0), "_label": F.lit(0)}) for x in (targets, sources))
    levels, placed = celltree.build(t, leaf=8)
    got = {}
    for r in sorted(celltree.search(s, levels, placed, k).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["source"], []).append((r["target"], r["rank"]))
    assert got == brute_nearest(sources, targets, k)


def test_far_clouds_bring_few_pairs_together(spark):
    """Two clouds far apart: rows met at all levels stay in proportion to the sources."""
    t = spark.createDataFrame(cloud(2000, 0, 1, 0), POINT).withColumns({"_by": F.lit(0), "_label": F.lit(0)})
    s = spark.createDataFrame(cloud(2000, (1e6, 0, 0), 2, 10000), POINT).withColumns({"_by": F.lit(0), "_label": F.lit(0)})
    levels, placed = celltree.build(t)
    sizes = [c.count() for c in levels]
    assert sum(sizes) < 2000
    near, _ = celltree._reach()
    deepest = levels[-1]
    # A source's candidates among the deepest cells: those that begin no farther than the best one surely ends.
    met = s.select("id", *(F.col(c).alias(f"s{c}") for c in "xyz")).join(deepest, F.lit(True)).select("id", near.alias("near"), celltree._reach()[1].alias("far"))
    best = met.groupBy("id").agg(F.min("far").alias("best"))
    assert met.join(best, "id").where("near <= best").count() < 0.5 * met.count()
    got = spatial.nearest(s.drop("_by", "_label"), t.drop("_by", "_label"), 1)
    want = brute_nearest(cloud(2000, (1e6, 0, 0), 2, 10000), cloud(2000, 0, 1, 0), 1)
    assert {r["source"]: [(r["target"], 1)] for r in got.collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_component_tree_equals_kruskal(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(j, *map(float, rng.integers(0, 12, 3)), int(rng.integers(0, 9))) for j in range(150)]
    got = {(r["source"], r["target"], round(r["distance"], 9)) for r in spatial.component_tree(spark.createDataFrame(rows, f"{POINT}, component int")).collect()}
    edges = sorted((float(np.sqrt(sum((a[c] - b[c]) ** 2 for c in (1, 2, 3)))), a[0], b[0], a[4], b[4]) for a in rows for b in rows if a[0] < b[0] and a[4] != b[4])
    up, want = {r[4]: r[4] for r in rows}, set()

    def top(c):
        while up[c] != c:
            c = up[c]
        return c

    for w, a, b, ca, cb in edges:
        if top(ca) != top(cb):
            up[top(ca)] = top(cb)
            want.add((a, b, round(w, 9)))
    assert got == want and len(got) == len(up) - 1


def test_component_tree_of_one_component(spark):
    assert spatial.component_tree(spark.createDataFrame([(1, 0.0, 0.0, 0.0, 5), (2, 1.0, 0.0, 0.0, 5)], f"{POINT}, component int")).collect() == []


@pytest.mark.parametrize("shape", ["random", "chain"])
def test_tree_distances_equal_walks(spark, shape):
    rng = random.Random(shape)
    parent = {k: (k - 1 if shape == "chain" else rng.randint(0, k - 1)) if k % 40 else None for k in range(120)}
    length = {k: float(rng.randint(1, 9)) for k in parent}

    def way_up(k):
        out = [k]
        while parent[out[-1]] is not None:
            out.append(parent[out[-1]])
        return out

    pairs = [(a, b) for a in range(0, 120, 7) for b in range(120)] + [(5, 5), (5, 5)]
    got = graph.tree_distances(spark.createDataFrame([(k, p, length[k]) for k, p in parent.items()], "id long, parent long, length double"), spark.createDataFrame(pairs, "a long, b long"))
    want = {}
    for a, b in pairs:
        up_a, up_b = way_up(a), way_up(b)
        meet = next((x for x in up_a if x in up_b), None)
        if meet is None:
            want[a, b] = (None, None, None)
        else:
            ways = up_a[: up_a.index(meet)] + up_b[: up_b.index(meet)]
            want[a, b] = (meet, len(ways), sum(length[x] for x in ways))
    assert {(r["a"], r["b"]): (r["meet"], r["steps"], r["distance"]) for r in got.collect()} == want
    assert got.count() == len(set(pairs))


def test_holes_of_many_voxels_are_filled_without_broadcasts_of_voxels(spark, monkeypatch):
    rows = spark.range(8000).selectExpr("0 as t", "0 as ch", "int(id div 400) as z", "int(id div 20 % 20) as y", "int(id % 20) as x", "int(if(id % 7 in (0, 3), 0, 1 + id % 3)) as label")
    want = sorted(map(tuple, distance.fill_holes(rows).collect()))
    monkeypatch.setattr(graph, "BROADCAST", 1000)
    filled = distance.fill_holes(rows)
    assert sorted(map(tuple, filled.collect())) == want
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    # All joins but that with the box of each time and channel.
    assert plan.count("strategy=merge") >= plan.count("Join ") - 1 >= 4
