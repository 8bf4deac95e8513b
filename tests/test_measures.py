import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import learning, spatial, statistics, tracks, voxels
from tessella.plans import steps
from tessella.sources import tables
from tessella.streaming.tracks import running_path


def points_of(spark, x, classes=None):
    rows = [(k, *map(float, v), None if classes is None else classes[k]) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, class int")


def brute_nearest(x, k, classes=None):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    if classes is not None:
        own = np.array([-1 if c is None else c for c in classes])
        d[own[:, None] != own[None, :]] = np.inf
    return {i: [int(j) for j in np.lexsort((np.arange(len(x)), d[i]))[:k] if np.isfinite(d[i, j])] for i in range(len(x))}


def found_nearest(edges):
    got = {}
    for r in edges.orderBy("source", "rank").collect():
        got.setdefault(r["source"], []).append(r["target"])
    return got


def test_nearest_with_outlier_dense_cluster_and_equal_places(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(150, 3)) * 1e-4 + 5, [[1e6, 0, 0]], np.full((60, 3), 2.0)])
    df = points_of(spark, x)
    assert found_nearest(spatial.nearest(df, df, 3)) == brute_nearest(x, 3)


def test_many_points_and_one_outlier_compare_few_pairs(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.random((4000, 3)), [[1e6, 0, 0]]])
    df = points_of(spark, x)
    # With cells for the whole extent all points would share one: 16 million pairs.
    assert spatial.nearest(df, df, 3).count() == 3 * len(x)


def test_nearest_within_classes_with_nulls(spark):
    rng = np.random.default_rng(3)
    x, classes = rng.random((90, 3)), [None if k % 3 == 0 else k % 3 if k % 7 else 9 for k in range(90)]
    df = points_of(spark, x, classes)
    assert found_nearest(spatial.within_class_nearest(df, 4)) == brute_nearest(x, 4, classes)
    lost = df.withColumn("y", F.when(F.col("id") == 5, F.lit(None)).when(F.col("id") == 6, F.lit(float("nan"))).otherwise(F.col("y")))
    assert not {5, 6} & set(found_nearest(spatial.nearest(lost, lost, 2)))


def test_boxes_meet_once_however_wide(spark):
    rng = np.random.default_rng(4)
    lo = rng.random((80, 2)) * 20 - 10
    hi = lo + rng.random((80, 2)) * np.where(np.arange(80) % 20 == 0, 30, 1)[:, None]
    rows = [(k, k % 2, *map(float, (*lo[k], *hi[k]))) for k in range(80)]
    df = spark.createDataFrame(rows, "id long, k int, lo_q double, lo_d double, hi_q double, hi_d double")
    expected = {(i, j) for i, j in itertools.combinations(range(80), 2) if i % 2 == j % 2 and (np.minimum(hi[i], hi[j]) > np.maximum(lo[i], lo[j])).all()}
    got = [(r["id_1"], r["id_2"]) for r in spatial.box_overlap(df, df, "k", ["q", "d"]).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def lloyd(v, first):
    centres = dict(enumerate(v[first]))
    for _ in range(50):
        cluster = np.array([min(centres, key=lambda c: (np.linalg.norm(p - centres[c]), c)) for p in v])
        moved = {int(c): v[cluster == c].mean(0) for c in np.unique(cluster)}
        if moved.keys() == centres.keys() and all(np.allclose(moved[c], centres[c]) for c in moved):
            break
        centres = moved
    return cluster


def test_kmeans_runs_until_no_centre_moves(spark):
    v = np.random.default_rng(5).normal(size=(120, 3)) + np.repeat([[0, 0, 0], [6, 0, 0], [0, 9, 0]], 40, axis=0)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    first = [r["id"] for r in df.orderBy(F.xxhash64("id"), "id").limit(3).collect()]
    assert {r["id"]: r["cluster"] for r in learning.kmeans(df, 3).collect()} == dict(enumerate(lloyd(v, first).tolist()))
    assert learning.kmeans(df.limit(0), 3).collect() == []


@pytest.mark.parametrize("linkage", ["single", "average", "complete"])
def test_cells_of_one_point_each_give_the_points_clustering(spark, linkage):
    v = np.random.default_rng(6).normal(size=(12, 2))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    cells, mergers = learning.cell_mergers(df, 12, linkage)
    member = {r["id"]: r["member"] for r in cells.collect()}
    assert sorted(member.values()) == list(range(12))
    groups = {m: [i] for i, m in member.items()}
    pick = {"single": np.min, "average": np.mean, "complete": np.max}[linkage]
    apart = lambda a, b: float(pick([[np.linalg.norm(v[i] - v[j]) for j in b] for i in a]))
    for r in mergers.orderBy("step").collect():
        best = min(apart(a, b) for a, b in itertools.combinations(groups.values(), 2))
        a, b = groups.pop(r["first"]), groups.pop(r["second"])
        assert r["distance"] == pytest.approx(best) == apart(a, b)
        groups[12 + r["step"]] = a + b
    assert len(groups) == 1


def test_clusters_of_cells_cover_all_points(spark):
    v = np.random.default_rng(7).normal(size=(200, 2)) + np.repeat([[0, 0], [30, 0]], 100, axis=0)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    cells, mergers = learning.cell_mergers(df, 16)
    found = cells.join(learning.cut_mergers(mergers, "g", 2), "member").collect()
    assert len(found) == 200 and len({(r["cluster"], r["id"] >= 100) for r in found}) == 2
    assert learning.elbow(mergers, "g").first()["clusters"] == 2


def edges_of(spark, seed, n=30):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) + np.repeat([[0, 0], [4, 0]], n // 2, axis=0)
    w = np.exp(-np.linalg.norm(x[:, None] - x[None], axis=2))
    rows = [(i, j, float(w[i, j])) for i in range(n) for j in range(i + 1, n)]
    return w, spark.createDataFrame(rows, "source long, target long, weight double")


def test_replicator_shares(spark):
    w, edges = edges_of(spark, 10)
    np.fill_diagonal(w, 0)
    x = np.full(len(w), 1 / len(w))
    for _ in range(8):
        x = x * (w @ x)
        x /= x.sum()
    got = {r["id"]: (r["share"], r["survives"]) for r in learning.replicator(edges, 8).collect()}
    assert [got[k][0] for k in range(len(w))] == pytest.approx(x.tolist())
    assert [got[k][1] for k in range(len(w))] == (x >= 0.1 * x.max()).tolist()


def test_diffusion_coordinates(spark):
    w, edges = edges_of(spark, 11)
    d = w.sum(1)
    values, vectors = np.linalg.eigh(w / np.sqrt(d[:, None] * d[None]))
    expected = np.abs(vectors[:, -2] * values[-2] / np.sqrt(d))
    got = {r["id"]: r["coordinates"] for r in learning.diffusion_map(edges, 2, 25).collect()}
    assert np.abs([got[k][0] for k in range(len(w))]) == pytest.approx(expected, abs=1e-4)
    assert learning.diffusion_map(edges.limit(0)).collect() == []


def test_fuzzy_centres_move_to_the_groups(spark):
    v = np.random.default_rng(8).normal(size=(100, 2)) * 0.1 + np.repeat([[0, 0], [5, 5]], 50, axis=0)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    told = learning.fuzzy_cmeans(df, [[1.0, 1.0], [3.0, 3.0]], 10).collect()
    assert all((r["membership"][0] > 0.9) == (r["id"] < 50) and sum(r["membership"]) == pytest.approx(1) for r in told)


def test_spectra_are_unmixed(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 0.0])], "id long, v array<double>")
    got = {r["id"]: [round(x, 9) for x in r["abundance"]] for r in learning.unmix(df, [[1.0, 1.0], [1.0, 2.0]]).collect()}
    assert got == {1: [2.0, 1.0], 2: [2.0, 0.0]}


def test_equal_count_bins(spark):
    got = statistics.equal_count_bins(spark.range(1000).select(F.col("id").cast("double").alias("v")), "v", 4).groupBy("bin").count().collect()
    assert sorted(r["bin"] for r in got) == [0, 1, 2, 3] and all(abs(r["count"] - 250) <= 5 for r in got)


def ball(radius, label=1, at=(0, 0, 0)):
    r = range(-radius, radius + 1)
    return [(0, 0, z + at[0], y + at[1], x + at[2], 10, label) for z in r for y in r for x in r if z * z + y * y + x * x <= radius * radius]


VOXELS = "t int, ch int, z int, y int, x int, value int, label int"


def test_moments_of_a_ball_and_a_rod(spark):
    rod = [(0, 0, 50, 0, 50 + k, 1, 2) for k in range(9)]
    got = {r["label"]: r for r in voxels.moments(spark.createDataFrame(ball(5) + rod, VOXELS)).collect()}
    assert got[1]["eccentricity"] == pytest.approx(0, abs=1e-3) and got[1]["elongation"] == pytest.approx(1, abs=1e-3)
    assert (got[2]["elongation"], got[2]["orientation"]) == (0.0, 0.0) and got[2]["major_axis"] == pytest.approx(4 * np.std(range(9)))


def test_surroundings(spark):
    df = spark.createDataFrame(ball(2), VOXELS)
    ring = [(0, 0, 0, 0, 3, 100, 0), (0, 0, 0, 3, 0, 100, 0), (0, 0, 0, -3, 0, 1, 0)]
    target = spark.createDataFrame(ring, VOXELS)
    assert [tuple(r) for r in voxels.surroundedness(df, target, 1, 50.0).collect()] == [(1, 2)]
    assert [tuple(r) for r in voxels.target_distance(df, target, 50.0).collect()] == [(1, 3.0)]
    assert voxels.target_distance(df, target, 500.0).collect() == []
    far = spark.createDataFrame([(7, 10.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert [tuple(r) for r in spatial.region_distance(far, df).collect()] == [(7, 8.0)]


def test_threshold_of_many_values(spark):
    rng = np.random.default_rng(9)
    values = np.concatenate([rng.normal(0, 1, 500), rng.normal(20, 1, 500)])
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    one_by_one, binned = (voxels.otsu(df, most).first()["threshold"] for most in (65536, 64))
    assert 1 < one_by_one < 17 and 1 < binned < 17


def test_text_forms(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1 2 3\n4,5,6\n")
    assert sorted(map(tuple, tables.load_points(spark, str(tmp_path / "p.txt")).collect())) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    (tmp_path / "t.txt").write_text("1 0 1.5 2 3\n1 1 2.5 2 3\n")
    assert sorted(map(tuple, tables.load_tracks(spark, str(tmp_path / "t.txt"), kymograph=True).collect())) == [(1, 0, 1.5, 2.0, 0.0), (1, 1, 2.5, 2.0, 1.0)]
    (tmp_path / "c.txt").write_text("id Soma_X len\n1 2 3\n")
    assert tables.load_cells(spark, str(tmp_path / "c.txt")).columns == ["id", "len"]
    # A line of data that equals the header stays, and so do files of one header.
    for name in "ab":
        (tmp_path / f"{name}.hdr").write_text("5 7\n1 2\n5 7\n")
    assert sorted(map(tuple, tables.load_table(spark, f"{tmp_path}/*.hdr").collect())) == [(1.0, 2.0)] * 2 + [(5.0, 7.0)] * 2
    (tmp_path / "b.hdr").write_text("7 5\n1 2\n")
    with pytest.raises(ValueError, match="different headers"):
        tables.load_table(spark, f"{tmp_path}/*.hdr")
    (tmp_path / "l.vtk").write_text("# vtk DataFile Version 3.0\nx\nASCII\nDATASET POLYDATA\nPOINTS 3 float\n0 0 0\n1 0 0 2 0 0\nLINES 2 5\n2 0 1\n1 2\n")
    assert sorted((r["line"] > 0, r["position"], r["id"], r["x"]) for r in tables.load_vtk_lines(spark, str(tmp_path / "l.vtk")).collect()) == [(False, 0, 0, 0.0), (False, 1, 1, 1.0), (True, 0, 2, 2.0)]


def test_written_forms(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 4.0, "b")], "id long, v double, name string")
    tables.save_table(df, f"{tmp_path}/one")
    assert spark.read.csv(f"{tmp_path}/one", sep="\t", header=True).count() == 2
    tables.save_table_append(df, f"{tmp_path}/more", 7)
    tables.save_table_append(df, f"{tmp_path}/more", 8)
    assert sorted(r["_c0"] for r in spark.read.csv(f"{tmp_path}/more", sep="\t").collect()) == ["7", "7", "8", "8"]
    tables.save_series(df.withColumn("time", F.col("id") % 2), f"{tmp_path}/series")
    assert spark.read.parquet(f"{tmp_path}/series").where("time = 1").count() == 1
    tables.save_ids(df, f"{tmp_path}/ids")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/ids").collect()) == ["1", "2"]
    tables.save_selected_features(df, ["v"], f"{tmp_path}/chosen")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/chosen/names").collect()] == ["v"]
    tables.save_graph(df.select("id"), df.select("id", "v"), f"{tmp_path}/graph")
    assert spark.read.csv(f"{tmp_path}/graph/edges", header=True).columns == ["id", "v"]
    tables.save_clustering(df, df.select("id"), f"{tmp_path}/clusters")
    assert spark.read.csv(f"{tmp_path}/clusters/members", header=True).count() == 2
    df.createOrReplaceTempView("some")
    tables.save_query(spark, "select id from some where v > :low", f"{tmp_path}/query", {"low": 3})
    assert [r[0] for r in spark.read.csv(f"{tmp_path}/query", header=True).collect()] == ["2"]
    tables.save_by_class(spark.createDataFrame(ball(1), VOXELS), spark.createDataFrame([(1, 4)], "label int, class int"), f"{tmp_path}/classes")
    assert spark.read.parquet(f"{tmp_path}/classes").where("class = 4").count() == 7
    rows = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 3.0, 0.0, 0.0)], "track int, t int, x double, y double, z double")
    tables.save_track_features(rows, f"{tmp_path}/tracks")
    assert spark.read.csv(f"{tmp_path}/tracks", sep="\t", header=True).first()["path"] == "3.0"


def test_track_edits(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 2, 3.0), (2, 3, 4.0)], "track long, t int, x double")
    assert {r["track"] for r in tracks.join_tracks(rows, 1, 2).collect()} == {1}
    assert {r["track"] for r in tracks.join_tracks(rows, 2, 1).collect()} == {1, 2}
    assert sorted((r["track"], r["t"]) for r in tracks.split_track(rows, 2, 3).collect()) == [(1, 0), (1, 1), (2, 2), (3, 3)]


PROJECT = """<ProjectFile><Inputs><file chname="dapi">a.tif</file></Inputs>
<PipelineSteps><step name="ZSCORE" columns="v,"/><step name="extract_class" column="class" value="1" columns="id,v"/></PipelineSteps>
<SqlQueryParameters><SqlQuery>select id from objects where v > 0</SqlQuery></SqlQueryParameters>
<AssociationRules><AssociationRule Name="r" Target_Image="gfp" Outside_Distance="3" Inside_Distance="0" Use_Whole_Object="True" Association_Type="AVERAGE"/></AssociationRules></ProjectFile>"""


def test_project_becomes_a_plan(spark):
    inputs, plan, rules = steps.from_project(PROJECT.replace('columns="v,"', 'columns="v,w"'))
    assert inputs == {"dapi": "a.tif"} and [n for n, _ in plan.steps] == ["zscore", "extract_class", "sql"]
    assert [(r.name, r.outside, r.mode) for r in rules] == [("r", 3, "AVERAGE")]
    df = spark.createDataFrame([(1, 0.0, 1.0, 1), (2, 4.0, 1.0, 1), (3, 2.0, 1.0, 2)], "id long, v double, w double, class int")
    assert [r["id"] for r in plan.run(df).collect()] == [2]


def test_running_path_over_a_stream(spark, tmp_path):
    for k, rows in enumerate([[("a", 1, 0.0), ("a", 2, 3.0), ("b", 1, 5.0)], [("a", 3, 1.0), ("b", 2, 5.5)]]):
        spark.createDataFrame(rows, "key string, t long, place double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("key string, t long, place double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = running_path(stream, "key", "t", "place").writeStream.format("memory").queryName("paths").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = spark.sql("select key, max(points) as points, max(path) as path from paths group by key").collect()
    assert sorted(map(tuple, last)) == [("a", 3, 5.0), ("b", 2, 0.5)]
