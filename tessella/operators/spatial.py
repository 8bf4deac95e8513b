"""Neighbour joins over points (id, x, y, z, and a class): grid cells make distance predicates equi-joins."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.operators import celltree
from tessella.operators.graph import components, kept, unbroadcast
from tessella.sources.shared import dropped

AXES = ("x", "y", "z")


def squared_distance(a: str, b: str) -> Column:
    return sum((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in AXES)


def _cells(points: DataFrame, size: float) -> DataFrame:
    return points.withColumn("_cell", F.struct(*(F.floor(F.col(c) / size).cast("long").alias(c) for c in AXES)))


def _around(points: DataFrame, size: float) -> DataFrame:
    """Each point once for its own cell and once for each of the 26 about it."""
    step = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    cell = _cells(points, size)
    for c in AXES:
        cell = cell.withColumn(f"_{c}", F.explode(step))
    moved = F.struct(*((F.col(f"_cell.{c}") + F.col(f"_{c}")).cast("long").alias(c) for c in AXES))
    return cell.withColumn("_cell", moved).drop("_x", "_y", "_z")


def within_radius(sources: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """source, target and distance of all pairs no farther apart than `radius`, a point and itself excluded."""
    s, t = _around(sources, radius).alias("s"), _cells(targets, radius).alias("t")
    pairs = s.join(t, F.col("s._cell") == F.col("t._cell")).where((F.col("s.id") != F.col("t.id")) & (squared_distance("s", "t") <= radius * radius))
    return pairs.select(F.col("s.id").alias("source"), F.col("t.id").alias("target"), F.sqrt(squared_distance("s", "t")).alias("distance"))


def _placed(points: DataFrame, by: str | None) -> DataFrame:
    """Points whose coordinates are numbers, with `_by`, what must be equal of a pair; nulls are equal."""
    real = points.where(sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int") for c in AXES) == 0)
    return real.withColumn("_by", F.struct(F.lit(0).alias("null"), F.lit(0).alias("value")) if by is None else F.struct(F.col(by).isNull().cast("int").alias("null"), F.coalesce(F.col(by).cast("string"), F.lit("")).alias("value")))


def nearest(sources: DataFrame, targets: DataFrame, k: int, cell: float | None = None, by: str | None = None) -> DataFrame:
    """source, target, distance and rank of each source's k nearest targets, itself excluded, ties to the smaller id.

    With `by`, only targets with the source's value of that column count; nulls are equal. Points with a missing
    coordinate take no part. Exact: a source is settled once k targets lie within the cell size of it; the cell doubles
    for the others. The first cell is so small that few targets share one where most targets are, however uneven
    they lie. As soon as few settle in a round, or larger cells would bring too many pairs together, the other sources go
    through a tree of cells instead (`celltree`), which no distance and no density makes slow. Of targets at one place only the first k + 1 by id can be among
    the nearest. A source with fewer than k targets in all gets those there are.
    """
    sources = _placed(sources, by)
    here = Window.partitionBy("_by", *AXES).orderBy("id")
    targets = kept(_placed(targets, by).select("id", *AXES, "_by").withColumn("_r", F.row_number().over(here)).where(F.col("_r") <= k + 1).drop("_r"))
    extent = targets.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k_}{c}") for c in AXES for k_, f in (("lo", F.min), ("hi", F.max)))).first()
    n = extent["n"]
    if not n:
        return sources.select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    width = max(max(extent[f"hi{c}"] - extent[f"lo{c}"] for c in AXES), 1e-9)
    size = cell or width * min(1.0, (max(k, 4) / n)) ** (1 / 3)
    shared = float(n)
    while cell is None and size > width * 1e-12:
        # How many targets share a cell with a target, on average: cells with many count more.
        shared = _cells(targets, size).groupBy("_by", "_cell").agg(F.count(F.lit(1)).alias("c")).agg((F.sum(F.col("c").cast("double") * F.col("c")) / F.sum("c")).alias("m")).first()["m"]
        if shared <= 16 * max(k, 4):
            break
        size /= min(16.0, max(2.0, (shared / (8 * max(k, 4))) ** (1 / 2)))
    best = Window.partitionBy("source").orderBy("distance", "target")
    out, open_ = None, kept(sources)
    many = open_.count()
    while True:
        s, t = unbroadcast(_around(open_, size), 27 * many).alias("s"), unbroadcast(_cells(targets, size), n).alias("t")
        pairs = s.join(t, (F.col("s._by") == F.col("t._by")) & (F.col("s._cell") == F.col("t._cell"))).where(F.col("s.id") != F.col("t.id"))
        pairs = pairs.select(F.col("s.id").alias("source"), F.col("t.id").alias("target"), F.sqrt(squared_distance("s", "t")).alias("distance"))
        ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        whole = Window.partitionBy("source")
        sure = ranked.withColumns({"_n": F.count(F.lit(1)).over(whole), "_d": F.max("distance").over(whole)})
        settled = kept(sure.where((F.col("_n") == k) & (F.col("_d") <= size)).drop("_n", "_d"))
        out = settled if out is None else out.unionByName(settled)
        before, open_ = open_, kept(open_.join(unbroadcast(settled.select(F.col("source").alias("id")).distinct(), many), "id", "left_anti"))
        dropped(before)
        left = open_.count()
        if not left:
            return out
        size, shared = 2 * size, min(float(n), 8 * shared)
        if left > 0.9 * many or left * shared > 150 * n or size >= width:
            levels, placed = celltree.build(targets.withColumn("_label", F.lit(0)), rows=n)
            return out.unionByName(celltree.search(open_.withColumn("_label", F.lit(0)), levels, placed, k, rows=max(n, left)))
        many = left


def component_tree(points: DataFrame, key: str = "component") -> DataFrame:
    """source, target and distance: the shortest edges that join all components of points (id, x, y, z, and the key) to a tree.

    Boruvka over components: in each round every one takes its least distance to another, ties by the smaller ids. Points are
    looked up in a tree of cells that knows which cells hold no other component.
    """
    state, taken = kept(points.select("id", *(F.col(c).cast("double").alias(c) for c in AXES), F.col(key).alias("_label"), F.lit(0).alias("_by"))), []
    while state.select("_label").distinct().limit(2).count() > 1:
        levels, placed = celltree.build(state)
        near = celltree.search(state, levels, placed, 1, unlike=True, once=True)
        at = state.select(F.col("id").alias("source"), F.col("_label").alias("_a"))
        to = state.select(F.col("id").alias("target"), F.col("_label").alias("_b"))
        edge = F.struct("distance", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "_a", "_b")
        best = kept(near.join(at, "source").join(to, "target").groupBy(F.col("_a").alias("_c")).agg(F.min(edge).alias("e")).select("e.*"))
        taken.append(best.select("source", "target", "distance").distinct())
        both = best.select(F.explode(F.array("_a", "_b")).alias("id")).distinct()
        place = components(both, best.select(F.col("_a").alias("source"), F.col("_b").alias("target")))
        before, state = state, kept(state.join(place.toDF("_label", "_to"), "_label", "left").withColumn("_label", F.coalesce("_to", "_label")).drop("_to"))
        dropped(before)
    return reduce(DataFrame.unionByName, taken) if taken else points.select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit(0.0).alias("distance")).limit(0)


def undirected(edges: DataFrame) -> DataFrame:
    """One row for each pair of ends, however often and in whichever direction it occurs."""
    return edges.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.min("distance").alias("distance"))


def mutual(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is there too, once each."""
    back = edges.select(F.col("source").alias("target"), F.col("target").alias("source"))
    return edges.join(back, ["source", "target"], "left_semi").where("source < target")


def mean_distance(points: DataFrame, edges: DataFrame, name: str = "mean_distance") -> DataFrame:
    """Each point with the mean distance of its edges, 0 without any."""
    mean = edges.groupBy(F.col("source").alias("id")).agg(F.avg("distance").alias(name))
    # Means are as many as points, and ids in order look small to Spark.
    return points.select("id").join(mean.hint("merge"), "id", "left").select("id", F.coalesce(name, F.lit(0.0)).alias(name))


def neighbour_count(points: DataFrame, edges: DataFrame, name: str = "neighbours") -> DataFrame:
    count = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias(name))
    return points.select("id").join(count, "id", "left").select("id", F.coalesce(name, F.lit(0)).alias(name))


def within_class_nearest(points: DataFrame, k: int) -> DataFrame:
    """Like `nearest`, among points of the same class; those without one are a class."""
    return nearest(points, points, k, by="class")


def reference_distances(points: DataFrame, references: list[tuple[int, float, float, float]]) -> DataFrame:
    """Distance to each of a few fixed places, one column each; places are literals, so nothing is joined."""
    return points.select("id", *(F.sqrt(sum((F.col(c) - v) * (F.col(c) - v) for c, v in zip(AXES, place, strict=True))).alias(f"distance_{n}") for n, *place in references))


def box_overlap(a: DataFrame, b: DataFrame, on: str, axes: list[str]) -> DataFrame:
    """Pairs of boxes (lo_<axis>, hi_<axis>) that share the key and overlap on every axis, with the overlap's size.

    Boxes meet in bins of the first axis, twice as wide as an average box, so that a box lies in less than two of them on
    average; a pair counts in the first bin that both reach.
    """
    lo, hi = f"lo_{axes[0]}", f"hi_{axes[0]}"
    width = a.select(lo, hi).unionByName(b.select(lo, hi)).agg(F.avg(F.col(hi) - F.col(lo)).alias("w")).first()["w"]
    size = F.lit(float(2 * width) if width and width > 0 else 1.0)
    bin_of = lambda c: F.floor(c / size).cast("long")
    x, y = (t.where(F.col(hi) >= F.col(lo)).withColumn("_bin", F.explode(F.sequence(bin_of(F.col(lo)), bin_of(F.col(hi))))).alias(n) for t, n in ((a, "a"), (b, "b")))
    sides = [F.least(f"a.hi_{c}", f"b.hi_{c}") - F.greatest(f"a.lo_{c}", f"b.lo_{c}") for c in axes]
    hit, overlap = F.lit(True), F.lit(1.0)
    for s in sides:
        hit, overlap = hit & (s > 0), overlap * s
    once = F.col("a._bin") == bin_of(F.greatest(f"a.{lo}", f"b.{lo}"))
    met = x.join(y, (F.col(f"a.{on}") == F.col(f"b.{on}")) & (F.col("a._bin") == F.col("b._bin")) & once & hit & (F.col("a.id") < F.col("b.id")))
    return met.select(F.col("a.id").alias("id_1"), F.col("b.id").alias("id_2"), overlap.alias("overlap"))


def voronoi(cells: DataFrame, seeds: DataFrame) -> DataFrame:
    """Each cell (id, x, y, z) with its nearest seed and the distance; ids of cells and seeds are of different kinds, so equal ones may meet."""
    moved = seeds.select((-F.col("id") - 1).alias("id"), *AXES)
    return nearest(cells.select("id", *AXES), moved, 1).select(F.col("source").alias("id"), (-F.col("target") - 1).alias("seed"), "distance")


def density(points: DataFrame, k: int = 5) -> DataFrame:
    """Adaptive Gaussian density: each point's kernel is as wide as its k-th neighbour is far, and sums its k neighbours; null where they coincide."""
    edges = nearest(points, points, k)
    wide = edges.groupBy("source").agg(F.max("distance").alias("width"), F.collect_list("distance").alias("_d"))  # k a point
    weight = F.aggregate("_d", F.lit(0.0), lambda s, d: s + F.exp(-d * d / (2 * F.col("width") * F.col("width"))))
    return wide.select(F.col("source").alias("id"), "width", F.when(F.col("width") > 0, weight / F.pow("width", F.lit(3.0))).alias("density"))


def transformed(points: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Points moved by an affine 3 x 4 matrix."""
    moved = {c: sum((F.col(a) * float(w) for a, w in zip(AXES, row[:3], strict=True)), F.lit(float(row[3]))) for c, row in zip(AXES, matrix, strict=True)}
    return points.select(*(moved[c].alias(c) if c in moved else F.col(c) for c in points.columns))


def _times(a: Column, b: Column) -> Column:
    """Product of 3 x 4 affine matrices held as arrays of 12."""
    out = []
    for i in range(3):
        for j in range(4):
            cell = sum((F.element_at(a, 4 * i + k + 1) * F.element_at(b, 4 * k + j + 1) for k in range(3)), F.element_at(a, 4 * i + 4) if j == 3 else F.lit(0.0))
            out.append(cell)
    return F.array(*out)


def to_anchor(pairs: DataFrame, anchor: int) -> DataFrame:
    """image, matrix and steps: every image's transform to the anchor, composed along shortest ways of pairwise ones.

    `pairs` has (source, target, matrix): an affine array of 12, row by row, from source to target. Among ways of
    equal steps the one over the smallest image counts. Images that no way reaches are left out.
    """
    one = F.array(*(F.lit(1.0 if i == j else 0.0) for i in range(3) for j in range(4)))
    seen = pairs.sparkSession.range(1).select(F.lit(anchor).cast(pairs.schema["source"].dataType).alias("image"), one.alias("matrix"), F.lit(0).alias("steps"))
    front = seen
    for k in itertools.count(1):
        reached = pairs.select("source", "target", F.col("matrix").alias("_m")).join(front.select(F.col("image").alias("target"), "matrix"), "target")
        fresh = reached.join(seen.select(F.col("image").alias("source")), "source", "left_anti")
        best = fresh.groupBy(F.col("source").alias("image")).agg(F.min_by(F.struct("matrix", "_m"), "target").alias("_p"))
        front = kept(best.select("image", _times(F.col("_p.matrix"), F.col("_p._m")).alias("matrix"), F.lit(k).alias("steps")))
        if front.isEmpty():
            break
        seen = kept(seen.unionByName(front))
    return seen


def attach(table: DataFrame, values: DataFrame, key: str = "id", default: float = 0.0) -> DataFrame:
    """Rows with the other table's columns by key; the default where it has none."""
    new = [c for c in values.columns if c != key]
    return table.join(values, key, "left").withColumns({c: F.coalesce(c, F.lit(default)) for c in new})


def nearest_of_class(points: DataFrame, of: int, reach: float) -> DataFrame:
    """Distance of every point to the nearest point of a class, null beyond the reach."""
    pairs = within_radius(points, points.where(F.col("class") == of), reach)
    return points.select("id").join(pairs.groupBy(F.col("source").alias("id")).agg(F.min("distance").alias("distance")), "id", "left")


def region_distance(points: DataFrame, region: DataFrame) -> DataFrame:
    """Distance of every point to the nearest boundary voxel of a region, a voxel table in which it has a label."""
    from tessella.operators.voxels import surface

    # Voxels are numbered below the points, so that none is taken for its own source.
    there = surface(region).select((-1 - F.monotonically_increasing_id()).alias("id"), *(F.col(c).cast("double").alias(c) for c in AXES))
    return nearest(points, there, 1).select(F.col("source").alias("id"), "distance")


def cell_graph(cells: DataFrame, k: int = 4) -> DataFrame:
    """Edges between each cell (root, soma_x, soma_y, soma_z) and its k nearest ones, once each."""
    placed = cells.select(F.col("root").alias("id"), *(F.col(f"soma_{c}").alias(c) for c in AXES))
    return undirected(nearest(placed, placed, k))


def graph_table(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the places of both ends."""
    a, b = (points.select(F.col("id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in AXES)) for end in ("source", "target"))
    return edges.join(a, "source").join(b, "target")


def angles_to(points: DataFrame, place: tuple[float, float, float]) -> DataFrame:
    """Azimuth, elevation and distance from every point to a place, in degrees."""
    from tessella.functions import scalar

    dx, dy, dz = (F.lit(float(v)) - F.col(c) for c, v in zip(AXES, place, strict=True))
    return points.select("id", scalar.azimuth(dx, dy).alias("azimuth"), scalar.elevation(dx, dy, dz).alias("elevation"), F.sqrt(dx * dx + dy * dy + dz * dz).alias("distance"))
