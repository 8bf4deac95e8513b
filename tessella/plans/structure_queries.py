"""Registered queries over points, graphs, tracks, forests and voxels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import graph, spatial, tracks, voxels
from tessella.registry import register, table
from tessella.streaming.tracks import windowed_activity

_P = "with p as (select vec_id as id, embedding[1]::double * 10 as x, embedding[2]::double * 10 as y, embedding[3]::double * 10 as z, label as class from embeddings)"
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def points(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *((e[k].cast("double") * 10).alias(c) for k, c in enumerate("xyz")), F.col("label").alias("class"))


def _edges(df):
    return df.select("source", "target", F.round("distance", 6).alias("distance"))


def _knn(where="true", k=5):
    return f"{_P}, n as (select a.id as source, b.id as target, {_D} as distance, row_number() over (partition by a.id order by {_D}, b.id) as rank from p a join p b on a.id <> b.id and {where}) select * from n where rank <= {k}"


@register("j03_knn_all", f"select source, target, round(distance, 6) as distance, rank::int as rank from ({_knn()})")
def _(spark, d):
    p = points(spark, d)
    return spatial.nearest(p, p, 5).select("source", "target", F.round("distance", 6).alias("distance"), "rank")


@register("j01_knn_by_class", f"select source, target, round(distance, 6) as distance from ({_knn('a.class = 1 and b.class = 2', 3)})")
def _(spark, d):
    p = points(spark, d)
    return _edges(spatial.nearest(p.where("class = 1"), p.where("class = 2"), 3))


@register("j05_knn_mean_distance", f"select v.vec_id as id, round(coalesce(avg(distance), 0), 6) as mean_distance from embeddings v left join ({_knn('a.class < 3')}) on v.vec_id = source group by 1")
def _(spark, d):
    p = points(spark, d)
    return spatial.mean_distance(p, spatial.nearest(p.where("class < 3"), p, 5)).select("id", F.round("mean_distance", 6).alias("mean_distance"))


@register("j07_knn_undirected", f"select least(source, target) as source, greatest(source, target) as target, round(min(distance), 6) as distance from ({_knn()}) group by 1, 2")
def _(spark, d):
    p = points(spark, d)
    return _edges(spatial.undirected(spatial.nearest(p, p, 5)))


@register("j11_knn_mutual", f"with n as ({_knn()}) select a.source, a.target, round(a.distance, 6) as distance from n a join n b on a.source = b.target and a.target = b.source where a.source < a.target")
def _(spark, d):
    p = points(spark, d)
    return _edges(spatial.mutual(spatial.nearest(p, p, 5)))


@register("j04_radius_edges", f"{_P} select a.id as source, b.id as target, round({_D}, 6) as distance from p a join p b on a.id <> b.id and {_D} <= 0.4")
def _(spark, d):
    p = points(spark, d)
    return _edges(spatial.within_radius(p, p, 0.4))


@register("j06_radius_count", f"{_P} select a.id, count(b.id) as neighbours from p a left join p b on a.id <> b.id and {_D} <= 0.5 group by 1")
def _(spark, d):
    p = points(spark, d)
    return spatial.neighbour_count(p, spatial.within_radius(p, p, 0.5))


@register("j13_within_class_knn", f"select source, target, round(distance, 6) as distance from ({_knn('a.class = b.class')})")
def _(spark, d):
    return _edges(spatial.within_class_nearest(points(spark, d), 5))


@register("j14_reference_distance", f"{_P} select id, round(sqrt(x * x + y * y + z * z), 6) as distance_0, round(sqrt((x - 1) * (x - 1) + (y - 2) * (y - 2) + (z + 1) * (z + 1)), 6) as distance_1 from p")
def _(spark, d):
    t = spatial.reference_distances(points(spark, d), [(0, 0.0, 0.0, 0.0), (1, 1.0, 2.0, -1.0)])
    return t.select("id", *(F.round(c, 6).alias(c) for c in ("distance_0", "distance_1")))


@register("j21_box_overlap", "with b as (select l_orderkey * 10 + l_linenumber as id, l_partkey as k, l_quantity as lo_q, l_quantity + 5 as hi_q, l_discount * 100 as lo_d, l_discount * 100 + 3 as hi_d from lineitem) select a.id as id_1, b.id as id_2, round((least(a.hi_q, b.hi_q) - greatest(a.lo_q, b.lo_q)) * (least(a.hi_d, b.hi_d) - greatest(a.lo_d, b.lo_d)), 6) as overlap from b a join b on a.k = b.k and a.id < b.id and least(a.hi_q, b.hi_q) > greatest(a.lo_q, b.lo_q) and least(a.hi_d, b.hi_d) > greatest(a.lo_d, b.lo_d)")
def _(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("k"), F.col("l_quantity").alias("lo_q"), (F.col("l_quantity") + 5).alias("hi_q"), (F.col("l_discount") * 100).alias("lo_d"), (F.col("l_discount") * 100 + 3).alias("hi_d"))
    return spatial.box_overlap(t, t, "k", ["q", "d"]).select("id_1", "id_2", F.round("overlap", 6).alias("overlap"))


_KE = f"k as (select least(source, target) as s, greatest(source, target) as t, min(distance) as w from ({_knn(k=2)}) group by 1, 2)"


@register("g02_components", f"with recursive {_KE}, e as (select s, t from k union select t, s from k), r as (select vec_id as id, vec_id as c from embeddings union select e.t, r.c from r join e on e.s = r.id) select id, min(c) as component from r group by id")
def _(spark, d):
    p = points(spark, d)
    return graph.components(p, spatial.nearest(p, p, 2))


# An edge belongs to the forest if no path of lighter edges joins its ends.
def _forest(k):
    return f"with recursive k as (select least(source, target) as s, greatest(source, target) as t, min(distance) as w from ({_knn(k=k)}) group by 1, 2), e as (select *, row_number() over (order by w, s, t) as r from k), b as (select s as a, t as z, r from e union all select t, s, r from e), h as (select r, s as node from e union select h.r, b.z from h join b on b.a = h.node and b.r < h.r)"


@register("g01_spanning_forest", f"{_forest(4)} select s as source, t as target, round(w, 6) as distance from e where not exists (select 1 from h where h.r = e.r and h.node = e.t)")
def _(spark, d):
    p = points(spark, d)
    return _edges(graph.spanning_forest(p, spatial.nearest(p, p, 4)))


_TREE = "t as (select o_orderkey as id, case when o_orderkey < 8 then -1 else o_orderkey // 2 end as parent from orders), n as (select t.id, case when p.id is null then -1 else t.parent end as parent from t left join t p on t.parent = p.id)"


def tree(spark, d):
    """A forest over order keys: half the key is the parent, if it is there."""
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") < 8, F.lit(-1)).otherwise(F.floor(F.col("o_orderkey") / 2)).cast("long").alias("parent"))
    there = t.select(F.col("id").alias("parent"), F.lit(True).alias("_there"))
    place = lambda c, m: (F.pmod(F.col("id") * c, F.lit(m)) / 10.0)
    return t.join(there, "parent", "left").select("id", F.when(F.col("_there"), F.col("parent")).otherwise(F.lit(-1)).cast("long").alias("parent"), place(7, 100).alias("x"), place(11, 90).alias("y"), place(13, 80).alias("z"), (F.pmod(F.col("id"), F.lit(5)) / 4.0 + 0.5).alias("r"))


_NODES = f"{_TREE}, s as (select id, parent, (id * 7 % 100) / 10.0 as x, (id * 11 % 90) / 10.0 as y, (id * 13 % 80) / 10.0 as z, (id % 5) / 4.0 + 0.5 as r from n)"


@register("g10_tree_depth", f"with recursive {_TREE}, w as (select id, id as root, 0 as depth from n where parent < 0 union all select n.id, w.root, w.depth + 1 from n join w on n.parent = w.id) select id, root, depth::bigint as depth from w")
def _(spark, d):
    return graph.forest_depths(tree(spark, d))


@register("w05_segments", f"with {_NODES} select a.id, round(coalesce(sqrt((a.x - p.x) ** 2 + (a.y - p.y) ** 2 + (a.z - p.z) ** 2), 0), 6) as length, round(case when p.id is null then 4.0 / 3 * pi() * a.r ** 3 else pi() * a.r * a.r * sqrt((a.x - p.x) ** 2 + (a.y - p.y) ** 2 + (a.z - p.z) ** 2) end, 6) as volume from s a left join s p on a.parent = p.id")
def _(spark, d):
    return graph.segments(tree(spark, d)).select("id", F.round("length", 6).alias("length"), F.round("volume", 6).alias("volume"))


@register("a23_cell_table", f"with recursive {_NODES}, w as (select id, id as root, 0 as depth from s where parent < 0 union all select s.id, w.root, w.depth + 1 from s join w on s.parent = w.id), c as (select parent as id, count(*) as children from s where parent >= 0 group by 1), g as (select a.id, coalesce(sqrt((a.x - p.x) ** 2 + (a.y - p.y) ** 2 + (a.z - p.z) ** 2), 0) as length from s a left join s p on a.parent = p.id) select root, count(*) as nodes, sum((coalesce(children, 0) = 0)::int)::bigint as leaves, sum((coalesce(children, 0) > 1)::int)::bigint as branch_points, max(depth)::bigint as max_depth, round(sum(length), 4) as total_length, round(max(length), 6) as max_length from w join g using (id) left join c using (id) group by root")
def _(spark, d):
    return graph.cell_table(tree(spark, d)).select("root", "nodes", "leaves", "branch_points", "max_depth", F.round("total_length", 4).alias("total_length"), F.round("max_length", 6).alias("max_length"))


_PAIR = f"with recursive {_NODES}, a as (select id as node from s where id not in (select parent from s) union all select s.parent from a join s on a.node = s.id where s.parent >= 0), l as (select node as id, count(*) as leaves from a group by node), k as (select parent as id, min(id) as a, max(id) as b from s where parent >= 0 group by parent having count(*) = 2), g as (select p.id, p.r, a.r as ra, b.r as rb, la.leaves as la, lb.leaves as lb, (a.x - p.x) * (b.x - p.x) + (a.y - p.y) * (b.y - p.y) + (a.z - p.z) * (b.z - p.z) as dot, sqrt((a.x - p.x) ** 2 + (a.y - p.y) ** 2 + (a.z - p.z) ** 2) * sqrt((b.x - p.x) ** 2 + (b.y - p.y) ** 2 + (b.z - p.z) ** 2) as size from k join s p on p.id = k.id join s a on a.id = k.a join s b on b.id = k.b join l la on la.id = k.a join l lb on lb.id = k.b)"


@register("x16_bifurcations", f"{_PAIR} select id, round(greatest(ra, rb) / least(ra, rb), 6) as daughter_ratio, round(case when size > 0 then degrees(acos(least(greatest(dot / size, -1.0), 1.0))) end, 3) as amplitude, round((ra ** 1.5 + rb ** 1.5) / r ** 1.5, 6) as pk_classic, round((ra ** 2 + rb ** 2) / r ** 2, 6) as pk_2, round(0.5 * r + 0.25 * ra + 0.25 * rb, 6) as hillman_threshold, round(case when la + lb > 2 then abs(la - lb)::double / (la + lb - 2) else 1 end, 6) as partition_asymmetry from g")
def _(spark, d):
    t = graph.bifurcations(tree(spark, d))
    return t.select("id", F.round("amplitude", 3).alias("amplitude"), *(F.round(c, 6).alias(c) for c in ("daughter_ratio", "pk_classic", "pk_2", "hillman_threshold", "partition_asymmetry")))


@register("g06_progression_path", "with recursive e as (select n_nationkey as s, (n_nationkey * 3 + 1) % 25 as t from nation union select (n_nationkey * 3 + 1) % 25, n_nationkey from nation), a as (select 0 as id, 0 as h union select e.t, a.h + 1 from a join e on e.s = a.id where a.h < 8), b as (select 9 as id, 0 as h union select e.t, b.h + 1 from b join e on e.s = b.id where b.h < 8), x as (select id, min(h) as h from a group by id), y as (select id, min(h) as h from b group by id) select x.id::bigint as id, x.h as from_start, y.h as to_end from x join y using (id) where x.h + y.h = (select h from x where id = 9)")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("source"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("long").alias("target"))
    return graph.between(graph.hops(n, 0, 8), graph.hops(n, 9, 8), 9)


_GAPS = f"with recursive {_NODES}, w as (select id, id as root, 0 as depth from s where parent < 0 union all select s.id, w.root, w.depth + 1 from s join w on s.parent = w.id), e as (select s.id as line, root, x, y, z, depth::double as length from s join w on s.id = w.id where s.id not in (select parent from s)), q as (select a.line, b.line as line2, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as gap, a.length as la, b.length as lb from e a join e b on a.line < b.line and a.root <> b.root and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.5), c as (select line, line2, gap, gap / 0.5 * (gap / (gap + la + lb)) as cost from q), f as (select *, row_number() over (partition by line order by cost, line2) as o, row_number() over (partition by line2 order by cost, line) as b from c)"


@register("j19_gaps", f"{_GAPS} select line, line2, gap, cost from f where o = 1 and b = 1")
def _(spark, d):
    t = tree(spark, d)
    place = graph.forest_depths(t)
    leaf = t.join(t.where("parent >= 0").select(F.col("parent").alias("id")).distinct(), "id", "left_anti").join(place, "id")
    return graph.gaps(leaf.select(F.col("id").alias("line"), "root", "x", "y", "z", F.col("depth").cast("double").alias("length")), 0.5)


_TR = "with t as (select user_id as track, event_id as t, value as x, value / 2 as y, 0.0 as z from events), s as (select *, coalesce(x - lag(x) over w, 0) as dx, coalesce(y - lag(y) over w, 0) as dy, coalesce(t - lag(t) over w, 0) as dt from t window w as (partition by track order by t)), u as (select *, sqrt(dx * dx + dy * dy) as step, case when dt > 0 then sqrt(dx * dx + dy * dy) / dt else 0 end as speed from s)"


def track_rows(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("track"), F.col("event_id").alias("t"), F.col("value").alias("x"), (F.col("value") / 2).alias("y"), F.lit(0.0).alias("z"))


@register("w01_track_steps", f"{_TR} select track, t, round(dx, 6) as dx, round(dy, 6) as dy, 0.0::double as dz, dt::bigint as dt, round(step, 6) as step, round(speed, 8) as speed from u")
def _(spark, d):
    return tracks.steps(track_rows(spark, d)).select("track", "t", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"), F.round("dz", 6).alias("dz"), F.col("dt").cast("long").alias("dt"), F.round("step", 6).alias("step"), F.round("speed", 8).alias("speed"))


@register("a24_track_summary", f"{_TR} select track, count(*) as points, round(coalesce(avg(case when dt > 0 then speed end), 0), 8) as avg_speed, round(coalesce(max(case when dt > 0 then speed end), 0), 8) as max_speed, round(coalesce(min(case when dt > 0 then speed end), 0), 8) as min_speed, round(sum(step), 4) as path, round(arg_max(x, t) - arg_min(x, t), 6) as net_x, round(arg_max(y, t) - arg_min(y, t), 6) as net_y, round(sqrt((arg_max(x, t) - arg_min(x, t)) ** 2 + (arg_max(y, t) - arg_min(y, t)) ** 2), 6) as net from u group by track")
def _(spark, d):
    t = tracks.summary(track_rows(spark, d))
    return t.select("track", "points", F.round("avg_speed", 8).alias("avg_speed"), F.round("max_speed", 8).alias("max_speed"), F.round("min_speed", 8).alias("min_speed"), F.round("path", 4).alias("path"), *(F.round(c, 6).alias(c) for c in ("net_x", "net_y", "net")))


@register("w02_subtrack_directions", f"{_TR}, v as (select *, sum(dx) over (partition by track) as wx, sum(dy) over (partition by track) as wy, row_number() over (partition by track order by t) as k from s) select track, t, round(sqrt(dx * dx + dy * dy), 6) as step, round(case when sqrt(dx * dx + dy * dy) * sqrt(wx * wx + wy * wy) > 0 then (dx * wx + dy * wy) / (sqrt(dx * dx + dy * dy) * sqrt(wx * wx + wy * wy)) end, 5) as path_cosine, round(dx, 6) as dx, round(dy, 6) as dy from v where k > 1")
def _(spark, d):
    return tracks.directions(track_rows(spark, d)).select("track", "t", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"), F.round("step", 6).alias("step"), F.round("path_cosine", 5).alias("path_cosine"))


@register("w05_path_length", "with g as (select label, embedding[1]::double - lag(embedding[1]::double) over w as dx, embedding[2]::double - lag(embedding[2]::double) over w as dy from embeddings window w as (partition by label order by vec_id)) select label, round(coalesce(sum(sqrt(dx * dx + dy * dy)), 0), 5) as length from g group by label")
def _(spark, d):
    t = table(spark, d, "embeddings").select("label", "vec_id", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xy")))
    return tracks.path_length(t, "label", "vec_id", ["x", "y"]).select("label", F.round("length", 5).alias("length"))


@register("w03_tile_offsets", "with t as (select o_custkey % 10 as tile, o_orderkey from orders), m as (select tile, max(o_orderkey) as top from t group by tile), o as (select tile, coalesce(sum(top) over (order by tile rows between unbounded preceding and 1 preceding), 0) as off from m) select t.tile, o_orderkey, (o_orderkey + off)::bigint as stitched_id from t join o on t.tile = o.tile")
def _(spark, d):
    return tracks.tile_offsets(table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("tile"), "o_orderkey"), "tile", "o_orderkey")


_FRAME = f"{_P}, q as (select a.id % 20 as t, a.id, b.id % 20 as t2, b.id as id2, {_D} as cost from p a join p b on b.id % 20 > a.id % 20 and b.id % 20 <= a.id % 20 + 2 and {_D} <= 0.8), f as (select *, row_number() over (partition by t, t2, id order by cost, id2) as o, row_number() over (partition by t, t2, id2 order by cost, id) as k from q)"


@register("j22_frame_association", f"{_FRAME} select t, id, t2, id2, cost from f where o = 1 and k = 1")
def _(spark, d):
    p = points(spark, d)
    return tracks.associate(p.select((F.col("id") % 20).alias("t"), "id", "x", "y", "z"), 0.8, window=2)


_V = "with v as (select (l_orderkey // 400) as z, (l_orderkey // 20) % 20 as y, l_orderkey % 20 as x, (sum(l_quantity))::int % 64 as value, (l_orderkey // 40) % 7 as label from lineitem group by l_orderkey)"


def voxel_rows(spark, d):
    k = F.col("l_orderkey")
    per = table(spark, d, "lineitem").groupBy(k).agg(F.sum("l_quantity").alias("q"))
    return per.select(F.lit(0).alias("t"), F.lit(0).alias("ch"), F.floor(k / 400).alias("z"), F.pmod(F.floor(k / 20), F.lit(20)).alias("y"), F.pmod(k, F.lit(20)).alias("x"), F.pmod(F.col("q").cast("int"), F.lit(64)).alias("value"), F.pmod(F.floor(k / 40), F.lit(7)).alias("label"))


@register("a02_voxel_intrinsic", f"{_V} select label, count(*) as volume, sum(value)::double as integrated_intensity, round(avg(x), 6) as centroid_x, round(avg(y), 6) as centroid_y, round(avg(z), 6) as centroid_z, max(x) - min(x) + 1 as box_x, max(y) - min(y) + 1 as box_y, max(z) - min(z) + 1 as box_z, round(avg(value), 6) as mean, median(value)::double as median, min(value)::double as minimum, max(value)::double as maximum, round(stddev_samp(value), 6) as sigma from v where label <> 0 group by label")
def _(spark, d):
    t = voxels.intrinsic(voxel_rows(spark, d))
    return t.select("label", "volume", "integrated_intensity", *(F.round(f"centroid_{c}", 6).alias(f"centroid_{c}") for c in "xyz"), *(f"box_{c}" for c in "xyz"), F.round("mean", 6).alias("mean"), "median", "minimum", "maximum", F.round("sigma", 6).alias("sigma"))


@register("a04_voxel_histogram_features", f"{_V}, c as (select label, value, count(*)::double as c from v where label <> 0 group by label, value), p as (select label, value, c / sum(c) over (partition by label) as p from c) select label, round(sum(p * p), 8) as energy, round(-sum(p * log2(p)), 6) as entropy, round((sum(p * value ** 3) - 3 * sum(p * value) * sum(p * value ** 2) + 2 * sum(p * value) ** 3) / (sum(p * value ** 2) - sum(p * value) ** 2) ** 1.5, 5) as skew from p group by label")
def _(spark, d):
    return voxels.histogram_features(voxel_rows(spark, d)).select("label", F.round("energy", 8).alias("energy"), F.round("entropy", 6).alias("entropy"), F.round("skew", 5).alias("skew"))


_WAY = "label, dz, dy, dx"
_TEXTURE = f"{_V}, o as (select *, least(floor(value * 8.0 / (max(value) over () + 1)), 7)::int as g from v where label <> 0), m as (select a.k as dz, b.k as dy, c.k as dx from (select unnest([-1, 0, 1]) as k) a, (select unnest([-1, 0, 1]) as k) b, (select unnest([-1, 0, 1]) as k) c where a.k * 9 + b.k * 3 + c.k > 0), pr as (select a.label, dz, dy, dx, a.g as i, b.g as j from o a cross join m join o b on b.label = a.label and b.z = a.z + dz and b.y = a.y + dy and b.x = a.x + dx), c as (select * from pr union all select {_WAY}, j, i from pr), n as (select {_WAY}, i, j, count(*)::double as c from c group by all), p as (select *, c / sum(c) over (partition by {_WAY}) as p from n), q as (select *, sum(p * i) over (partition by {_WAY}) as mu from p), f as (select {_WAY}, sum(p * p) as t_energy, -sum(p * log2(p)) as t_entropy, sum(p / (1 + (i - j) ** 2)) as inverse_diff_moment, sum(p * (i - j) ** 2) as inertia, sum(p * (i + j - 2 * mu) ** 3) as cluster_shade, sum(p * (i + j - 2 * mu) ** 4) as cluster_prominence from q group by {_WAY})"
_TEXTURES = ("t_energy", "t_entropy", "inverse_diff_moment", "inertia", "cluster_shade", "cluster_prominence")


@register("a08_voxel_texture", f"{_TEXTURE} select l.label, {', '.join(f'round(coalesce(avg({c}), 0), 5) as {c}' for c in _TEXTURES)} from (select distinct label from o) l left join f on l.label = f.label group by l.label")
def _(spark, d):
    return voxels.texture(voxel_rows(spark, d)).select("label", *(F.round(c, 5).alias(c) for c in _TEXTURES))


@register("j09_region_adjacency", f"{_V}, n as (select a.label as a, b.label as b from v a join v b on abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 where a.label < b.label and a.label <> 0) select a as source, b as target, count(*) as faces from n group by 1, 2")
def _(spark, d):
    return voxels.adjacency(voxel_rows(spark, d))


@register("a10_association_average", f"{_V}, o as (select label as id, avg(x) as x, avg(y) as y, avg(z) as z from v where label <> 0 group by label) select o.id, round(coalesce(avg(case when v.value >= 20 then v.value end), 0), 6) as measure from o left join v on (v.x - o.x) ** 2 + (v.y - o.y) ** 2 + (v.z - o.z) ** 2 <= 36 group by o.id")
def _(spark, d):
    v = voxel_rows(spark, d)
    objects = v.where("label <> 0").groupBy(F.col("label").alias("id")).agg(*(F.avg(c).alias(c) for c in "xyz"))
    return voxels.association(objects, v, 6.0, "AVERAGE", 20).select("id", F.round("measure", 6).alias("measure"))


@register("a30_overlap_percent", f"{_V} select round(100.0 * avg((value > 30)::int::double), 6) as percent from v where label > 0")
def _(spark, d):
    t = voxel_rows(spark, d).withColumn("value", F.col("value") - 30)
    return voxels.overlap_percent(t).select(F.round("percent", 6).alias("percent"))


@register("s01_windowed_activity", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean, min(value) as low, max(value) as high from events group by 1, 2")
def _(spark, d):
    return windowed_activity(table(spark, d, "events"), "ts", "event_type", "value").select("start", "event_type", "n", F.round("mean", 6).alias("mean"), "low", "high")
