import random
import time
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import graph, learning, spatial, statistics, traces, voxels
from tessella.sources import tables


def forest(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        parent = rng.choice([-1, *range(k)]) if k and rng.random() < 0.06 else max(0, k - rng.randint(1, 4)) if k else -1
        rows.append((k, parent, rng.random() * 10, rng.random() * 10, rng.random() * 10, 1.0))
    return rows


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(forest(3), "id long, parent long, x double, y double, z double, r double")


def kids_of(rows):
    kids = defaultdict(list)
    for k, p, *_ in rows:
        if p >= 0:
            kids[p].append(k)
    return kids


def test_subtree_sums_and_heights(nodes):
    rows = forest(3)
    kids = kids_of(rows)

    def below(k):
        return [k, *(x for c in kids[k] for x in below(c))]

    got = {r["id"]: r["value"] for r in graph.subtree(nodes, F.col("id")).collect()}
    assert got == {k: sum(below(k)) for k, *_ in rows}
    got = {r["id"]: r["value"] for r in graph.subtree(nodes, F.col("id"), "max").collect()}
    assert got == {k: max(below(k)) for k, *_ in rows}
    assert {r["id"]: r["leaves"] for r in graph.leaf_counts(nodes).collect()} == {k: sum(not kids[x] for x in below(k)) for k, *_ in rows}


def test_backbone_is_a_longest_path(nodes):
    rows = forest(3)
    near = defaultdict(set)
    for k, p, *_ in rows:
        if p >= 0:
            near[k].add(p)
            near[p].add(k)

    def steps(start):
        seen, todo = {start: 0}, deque([start])
        while todo:
            k = todo.popleft()
            for x in near[k]:
                if x not in seen:
                    seen[x] = seen[k] + 1
                    todo.append(x)
        return seen

    found = defaultdict(set)
    for r in graph.backbone(nodes).collect():
        found[r["root"]].add(r["id"])
    for root, path in found.items():
        tree = steps(root)
        assert len(path) == max(max(steps(k).values()) for k in tree) + 1
        inside = {k: len(near[k] & path) for k in path}
        assert len(path) == 1 or sorted(inside.values()) == [1, 1] + [2] * (len(path) - 2)
    assert set(found) == {k for k, p, *_ in rows if p < 0}


def test_lines_and_their_edits(nodes):
    rows = forest(3)
    kids, parent = kids_of(rows), {k: p for k, p, *_ in rows}
    line = {}
    for k in sorted(parent):
        line[k] = line[parent[k]] if parent[k] >= 0 and len(kids[parent[k]]) == 1 else k
    assert {r["id"]: r["line"] for r in traces.with_lines(nodes).collect()} == line
    table = {r["line"]: r for r in traces.line_table(nodes).collect()}
    assert {k: r["size"] for k, r in table.items()} == {k: list(line.values()).count(k) for k in set(line.values())}
    assert all(r["parent_line"] == (line[parent[k]] if parent[k] >= 0 else -1) for k, r in table.items())
    gone = {k for k, r in table.items() if r["size"] == 1 and r["leaf"]}
    left = traces.without_lines(nodes, traces.short_lines(traces.line_table(nodes), 1))
    assert {r["id"] for r in left.collect()} == {k for k in parent if line[k] not in gone}
    assert traces.split_at(nodes, 5).where("id = 5").first()["parent"] == -1
    roots = [k for k, p in parent.items() if p < 0]
    hung = traces.with_soma(nodes, nodes.where("parent < 0").select("id"))
    assert {r["parent"] for r in hung.where(F.col("id").isin(roots)).collect()} == {60} and hung.where("id = 60").first()["parent"] == -1
    with pytest.raises(ValueError):
        traces.merged(nodes, roots[0], roots[0])


def test_neighbours_differ_in_colour(spark):
    rng = random.Random(1)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(120)}
    v = spark.createDataFrame([(k,) for k in range(41)], "id long")
    e = spark.createDataFrame([(a, b, rng.random()) for a, b in edges], "source long, target long, distance double")
    colour = {r["id"]: r["colour"] for r in graph.colouring(v, e).collect()}
    assert set(colour) == set(range(41)) and all(colour[a] != colour[b] for a, b in edges if a != b)
    plain = {(min(a, b), max(a, b)) for a, b in edges if a != b}
    rank = graph.cycle_rank(v, e).agg(F.sum("cycles"), F.sum("edges")).first()
    assert rank[1] == len(plain) and graph.chords(v, e).count() == rank[0]


def test_transforms_compose(spark):
    rng = np.random.default_rng(2)
    parts = {k: rng.normal(size=(3, 4)) for k in range(1, 6)}
    way = {1: 0, 2: 1, 3: 2, 4: 0, 5: 4}
    pairs = spark.createDataFrame([(k, way[k], parts[k].reshape(-1).tolist()) for k in parts], "source int, target int, matrix array<double>")
    whole = {0: np.eye(4)}
    for k in sorted(parts):
        whole[k] = whole[way[k]] @ np.vstack([parts[k], [0, 0, 0, 1]])
    got = {r["image"]: np.array(r["matrix"]).reshape(3, 4) for r in spatial.to_anchor(pairs, 0).collect()}
    assert set(got) == set(whole) and all(np.allclose(got[k], whole[k][:3]) for k in whole)


def test_cut_mergers_leave_so_many_clusters(spark):
    # 0.0, 0.1, 5.0, 5.1 and 20.0 by single linkage, in two groups.
    steps = [(0, 0, 1, 0.1), (1, 2, 3, 0.1), (2, 5, 6, 4.9), (3, 7, 4, 14.9)]
    mergers = spark.createDataFrame([(g, *s) for g in "gh" for s in steps], "g string, step int, first long, second long, distance double")
    got = defaultdict(set)
    for r in learning.cut_mergers(mergers, "g", 3).collect():
        got[r["g"], r["cluster"]].add(r["member"])
    assert dict(got) == {(g, c): s for g in "gh" for c, s in ((0, {0, 1}), (2, {2, 3}), (4, {4}))}
    assert [r["clusters"] for r in learning.elbow(mergers, "g").collect()] == [2, 2]


def test_model_rows_round_trip(spark):
    model = learning.model_table(spark, [1.0, 2.0], [3.0, 4.0], [[0.5, 1.0, 2.0], [0.0, 1.0, 1.0]])
    assert learning.from_model_table(model) == ([1.0, 2.0], [3.0, 4.0], [[0.5, 1.0, 2.0], [0.0, 1.0, 1.0]])


def test_modules_join_what_correlates(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 300))
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([a, a + 0.1 * b, b, -b])], "p double, q double, r double, s double")
    got = {r["feature"]: r["module"] for r in statistics.feature_modules(df, ["p", "q", "r", "s"], 0.8).collect()}
    assert got["p"] == got["q"] and len(set(got.values())) == 3


def test_voxel_parts(spark):
    rng = random.Random(7)
    rows = [(0, 0, z, y, x, rng.randrange(50), rng.choice([0, 0, 1, 2])) for z in range(3) for y in range(5) for x in range(5)]
    df = spark.createDataFrame(rows, "t int, ch int, z int, y int, x int, value int, label int")
    own = {k: [(z, y, x) for _, _, z, y, x, _, n in rows if n == k] for k in (1, 2)}
    near = {k: max((v for _, _, z, y, x, v, n in rows if n != k and any((z - a) ** 2 + (y - b) ** 2 + (x - c) ** 2 <= 1 for a, b, c in own[k])), default=0) for k in (1, 2)}
    assert {r["label"]: r["measure"] for r in voxels.shell_association(df, df, 1, "MAX").collect()} == near
    lone = df.where("label = 1")
    assert voxels.touching_border(lone, (3, 100, 100)).count() == int(any(y == 0 or x == 0 for _, y, x in own[1]))
    halves = voxels.split_along_z(df, 1, 1).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in halves}[3] == sum(z >= 1 for z, _, _ in own[1])
    flat = voxels.gradients(df.withColumn("value", F.col("x") * 2)).collect()
    assert all(0 <= r["surface_gradient"] <= 2 for r in flat)


def test_texture_is_the_mean_over_all_directions(spark):
    rng = random.Random(11)
    rows = [(0, 0, z, y, x, rng.randrange(64), rng.choice([0, 1, 1, 2, 2])) for z in range(3) for y in range(4) for x in range(5)]
    rows += [(0, 0, 20, 3 * k, 0, 63, 3) for k in range(2)] + [(0, 0, 30, k, 0, 9 * k, 4) for k in range(4)]
    df = spark.createDataFrame(rows, "t int, ch int, z int, y int, x int, value int, label int")
    grey = {(z, y, x): (n, v * 8 // 64) for _, _, z, y, x, v, n in rows if n}
    ways = [w for w in np.ndindex(3, 3, 3) if w > (1, 1, 1)]
    want = {}
    for label in (1, 2, 3, 4):
        per = []
        for w in ways:
            c = np.zeros((8, 8))
            for at, (n, i) in grey.items():
                m, j = grey.get(tuple(a + b - 1 for a, b in zip(at, w, strict=True)), (0, 0))
                if n == m == label:
                    c[i, j] += 1
                    c[j, i] += 1
            if c.sum():
                q = c / c.sum()
                i, j = np.indices((8, 8))
                s = i + j - 2 * (q * i).sum()
                per.append([(q * q).sum(), -(q[q > 0] * np.log2(q[q > 0])).sum(), (q / (1 + (i - j) ** 2)).sum(), (q * (i - j) ** 2).sum(), (q * s**3).sum(), (q * s**4).sum()])
        want[label] = np.mean(per, 0) if per else np.zeros(6)
    got = {r["label"]: list(r)[1:] for r in voxels.texture(df).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_images_rules_and_traces_from_files(spark, tmp_path):
    data = np.arange(24, dtype="<u2").reshape(2, 3, 4)
    (tmp_path / "v.raw").write_bytes(data.tobytes())
    got = tables.load_raw_volumes(spark, f"{tmp_path}/v.raw", (2, 3, 4), "uint16")
    assert {(r["z"], r["y"], r["x"]): r["value"] for r in got.collect()} == {i: float(v) for i, v in np.ndenumerate(data)}
    rules = [tables.Rule("a", "DAPI", 3, 1, True, "AVERAGE")]
    assert tables.load_rules(tables.rules_xml(rules)) == rules
    (tmp_path / "h.txt").write_text("ID size\n")
    (tmp_path / "d.txt").write_text("1 2.5\n2 3.5\n")
    assert tables.load_with_header(spark, f"{tmp_path}/h.txt", f"{tmp_path}/d.txt").columns == ["ID", "size"]
    (tmp_path / "t.xml").write_text('<Trace><TraceLine ID="1" Type="3" Parent="-1"><TraceBit ID="5" X="1" Y="2" Z="3"/><TraceBit ID="6" X="2" Y="2" Z="3"/></TraceLine></Trace>')
    assert [(r["line"], r["id"], r["x"]) for r in tables.load_trace_xml(spark, f"{tmp_path}/t.xml").orderBy("position").collect()] == [(1, 5, 1.0), (1, 6, 2.0)]


def test_gaps_are_those_of_all_pairs_and_crowds_do_not_meet(spark):
    rng, columns = np.random.default_rng(7), "line long, root long, x double, y double, z double, length double"
    rows = [(k, k // 20, *map(float, rng.integers(0, 9, 2) / 10), 0.0, float(k % 4 + 1)) for k in range(200)]
    rows += [(200 + k, k % 3, *map(float, rng.random(3)), float(k % 5 + 1)) for k in range(200)]
    cost = {}
    for a in rows:
        for b in rows:
            gap = sum((p - q) * (p - q) for p, q in zip(a[2:5], b[2:5], strict=True)) ** 0.5
            if a[0] < b[0] and a[1] != b[1] and gap <= 0.5:
                cost[a[0], b[0]] = gap / 0.5 * (gap / (gap + a[5] + b[5]))
    forth, back = {}, {}
    for (a, b), c in cost.items():
        forth[a], back[b] = min(forth.get(a, (9, 0)), (c, b)), min(back.get(b, (9, 0)), (c, a))
    got = {(r["line"], r["line2"]) for r in graph.gaps(spark.createDataFrame(rows, columns), 0.5).collect()}
    assert got == {(a, b) for a, (_, b) in forth.items() if back[b][1] == a} and len(got) > 20
    # 800 million pairs at one place: as a table they would not fit a test's time.
    start = time.monotonic()
    crowd = spark.range(40000).selectExpr("id as line", "id % 2 as root", "0.5D as x", "0D as y", "0D as z", "1D as length")
    assert sorted((r["line"], r["line2"], r["cost"]) for r in graph.gaps(crowd, 0.5).collect()) == [(0, 1, 0.0), (1, 2, 0.0)]
    assert time.monotonic() - start < 60


def test_many_points_meet_without_broadcasts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(k, *map(float, v), 0) for k, v in enumerate(rng.normal(size=(300, 3)))], "id long, x double, y double, z double, class int")
    want = sorted(map(tuple, spatial.mean_distance(df, spatial.nearest(df, df, 3)).collect()))
    monkeypatch.setattr(graph, "BROADCAST", 10)
    told = spatial.mean_distance(df, spatial.nearest(df, df, 3))
    got = sorted(map(tuple, told.collect()))
    assert [r[0] for r in got] == [r[0] for r in want] and np.allclose([r[1] for r in got], [r[1] for r in want], rtol=1e-12)
    assert "strategy=merge" in told._jdf.queryExecution().optimizedPlan().toString()
    assert "Broadcast" not in told._jdf.queryExecution().executedPlan().toString()
