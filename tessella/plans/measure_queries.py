"""Registered queries over image parts, tracks in time, modules, and the smaller measures and edits."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessella.functions import scalar
from tessella.operators import clusters, filters, learning, spatial, statistics, tracks, voxels
from tessella.plans.object_queries import r6, vectors
from tessella.plans.structure_queries import _D, _P, _TR, _V, _knn, points, track_rows, voxel_rows
from tessella.plans.trace_queries import _JOINS
from tessella.registry import register, table
from tessella.sources import tables

_MOMENTS = f"""{_V}, m as (select label, var_pop(x) as xx, var_pop(y) as yy, var_pop(z) as zz, covar_pop(x, y) as xy, covar_pop(x, z) as xz, covar_pop(y, z) as yz from v where label <> 0 group by label),
q as (select *, (xx + yy + zz) / 3 as q from m), p as (select *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) as p from q),
d as (select *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p ** 3) as r from p),
f as (select *, acos(least(greatest(r, -1.0), 1.0)) / 3 as f from d), e as (select *, greatest(q + 2 * p * cos(f), 0.0) as e1, greatest(q + 2 * p * cos(f + 2 * pi() / 3), 0.0) as e3 from f)"""


@register("a02_voxel_moments", f"{_MOMENTS} select label, round(4 * sqrt(e1), 5) as major_axis, round(4 * sqrt(greatest(3 * q - e1 - e3, 0)), 5) as middle_axis, round(4 * sqrt(e3), 5) as minor_axis, round(sqrt((e1 - e3) / e1), 6) as eccentricity, round(sqrt(e1 / e3), 5) as elongation, round(degrees(atan2(2 * xy, xx - yy) / 2), 4) as orientation from e")
def _(spark, d):
    t = voxels.moments(voxel_rows(spark, d))
    return t.select("label", *(F.round(c, 5).alias(c) for c in ("major_axis", "middle_axis", "minor_axis")), *r6("eccentricity"), F.round("elongation", 5).alias("elongation"), F.round("orientation", 4).alias("orientation"))


_SURFACE = f"{_V}, s as (select distinct a.label, a.x, a.y, a.z from v a {_JOINS} where a.label <> 0 and (" + " or ".join(f"n{k}.label is null or n{k}.label <> a.label" for k in range(6)) + ")), c as (select label, avg(x) as cx, avg(y) as cy, avg(z) as cz from v where label <> 0 group by label)"


@register("a07_radius_variation", f"{_SURFACE} select s.label, round(avg(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)), 6) as radius, round(stddev_pop(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)), 6) as radius_variation from s join c on s.label = c.label group by s.label")
def _(spark, d):
    return voxels.radius_variation(voxel_rows(spark, d)).select("label", *r6("radius", "radius_variation"))


@register("a11_surroundedness", f"{_SURFACE}, h as (select distinct s.label, v.x, v.y, v.z, v.value from s join v on (v.x - s.x) ** 2 + (v.y - s.y) ** 2 + (v.z - s.z) ** 2 <= 4 where v.label <> s.label), g as (select h.label, least(floor((case when atan2(y - cy, x - cx) < 0 then atan2(y - cy, x - cx) + 2 * pi() else atan2(y - cy, x - cx) end) * 8 / (2 * pi())), 7) as sector, z < cz as below, sum(value) as v from h join c on h.label = c.label group by 1, 2, 3) select c.label, count(v) as directions from c left join g on g.label = c.label and g.v > 60 group by c.label")
def _(spark, d):
    v = voxel_rows(spark, d)
    return voxels.surroundedness(v, v, 2, 60.0)


@register("a11_target_distance", f"{_V}, c as (select label, avg(x) as cx, avg(y) as cy, avg(z) as cz from v where label <> 0 group by label) select c.label, round(min(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)), 6) as distance from c, v where value >= 60 group by c.label")
def _(spark, d):
    v = voxel_rows(spark, d)
    return voxels.target_distance(v, v, 60.0).select("label", *r6("distance"))


@register("j17_region_distance", f"{_SURFACE}, p as (select vec_id as id, embedding[1]::double * 10 as x, embedding[2]::double * 10 as y, embedding[3]::double * 10 as z from embeddings) select id, round(min(sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2 + (p.z - s.z) ** 2)), 6) as distance from p, s group by id")
def _(spark, d):
    return spatial.region_distance(points(spark, d), voxel_rows(spark, d)).select("id", *r6("distance"))


@register("j18_cell_graph", f"select least(source, target) as source, greatest(source, target) as target, round(min(distance), 6) as distance from ({_knn(k=4)}) group by 1, 2")
def _(spark, d):
    cells = points(spark, d).select(F.col("id").alias("root"), *(F.col(c).alias(f"soma_{c}") for c in "xyz"))
    return spatial.cell_graph(cells).select("source", "target", *r6("distance"))


@register("j08_graph_table", f"{_P} select a.id as source, b.id as target, round({_D}, 6) as distance, round(a.x, 6) as source_x, round(b.z, 6) as target_z from p a join p b on a.id <> b.id and {_D} <= 0.3")
def _(spark, d):
    p = points(spark, d)
    return spatial.graph_table(p, spatial.within_radius(p, p, 0.3)).select("source", "target", *r6("distance", "source_x", "target_z"))


@register("j10_neighbours_of", f"{_V} select distinct b.label from v a join v b on abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 where a.label = 3 and b.label not in (0, 3)")
def _(spark, d):
    return voxels.neighbours_of(voxels.adjacency(voxel_rows(spark, d)), 3)


@register("i03_crop", f"{_V} select z - 1 as z, y - 3 as y, x - 5 as x, value, label from v where z between 1 and 20 and y between 3 and 12 and x between 5 and 15")
def _(spark, d):
    return voxels.crop(voxel_rows(spark, d), (1, 3, 5), (20, 12, 15)).select("z", "y", "x", "value", "label")


@register("i03_masked", f"{_V} select z, y, x, (case when label > 2 then value else 0 end)::int as value from v")
def _(spark, d):
    v = voxel_rows(spark, d)
    return voxels.masked(v, v.withColumn("value", F.col("label") - 2)).select("z", "y", "x", "value")


@register("i03_appended", f"{_V} select 0 as ch, z, y, x, value from v union all select 1, z, y, x, value from v where label = 2")
def _(spark, d):
    v = voxel_rows(spark, d)
    return voxels.appended(v, v.where("label = 2"), "ch").select("ch", "z", "y", "x", "value")


@register("i06_tiles", f"{_V}, t as (select unnest([0, 1, 2, 3]) as k) select z, y, x, a.k::bigint as tile_y, b.k::bigint as tile_x, a.k = y // 6 and b.k = x // 6 as own from v, t a, t b where y between a.k * 6 - 2 and a.k * 6 + 7 and x between b.k * 6 - 2 and b.k * 6 + 7")
def _(spark, d):
    return voxels.tiles(voxel_rows(spark, d), 6, 2).select("z", "y", "x", "tile_y", "tile_x", "own")


@register("i06_stitched", f"{_V}, t as (select *, y // 10 as ty, x // 10 as tx from v), m as (select ty, tx, max(label) as top from t group by 1, 2), o as (select ty, tx, coalesce(sum(top) over (order by ty, tx rows between unbounded preceding and 1 preceding), 0) as before from m) select z, y, x, (case when label > 0 then label + before else 0 end)::bigint as label from t join o on t.ty = o.ty and t.tx = o.tx")
def _(spark, d):
    return voxels.stitched(voxels.tiles(voxel_rows(spark, d), 10, 1)).select("z", "y", "x", F.col("label").cast("long").alias("label"))


@register("z10_points_with_track_features", f"{_TR}, f as (select track, sum(step) as path, count(*) as points from u group by track) select s.track, s.t, round(path, 4) as track_path, points as track_points from s join f on s.track = f.track")
def _(spark, d):
    rows = track_rows(spark, d)
    return tracks.with_track_features(rows, tracks.summary(rows)).select("track", "t", F.round("track_path", 4).alias("track_path"), "track_points")


_FRAMES = "with r as (select user_id as track, event_id % 50 as t, value as x from events), a as (select track, t, avg(x) as x from r group by 1, 2)"


@register("a25_per_time", f"{_FRAMES}, s as (select *, abs(coalesce(x - lag(x) over (partition by track order by t), 0)) as step, min(t) over (partition by track) as first, max(t) over (partition by track) as last, min(t) over () as lo, max(t) over () as hi from a) select t, count(distinct track) as tracks, sum((t = first and t > lo)::int)::bigint as appear, sum((t = last and t < hi)::int)::bigint as disappear, round(avg(step), 6) as mean_step from s group by t")
def _(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("track"), (F.col("event_id") % 50).alias("t")).agg(F.avg("value").alias("x"))
    return tracks.per_time(e.withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})).select("t", "tracks", "appear", "disappear", *r6("mean_step"))



@register("z04_split_track", "select user_id as track0, event_id as t, case when user_id = 1 and event_id >= 500 then (select max(user_id) + 1 from events) else user_id end as track from events")
def _(spark, d):
    rows = track_rows(spark, d).withColumn("track0", F.col("track"))
    return tracks.split_track(rows, 1, 500).select("track0", "t", "track")


@register("z04_joined_tracks", "select event_id as t, case when event_id % 10 = 0 then 1 else event_id // 400 end as track from events")
def _(spark, d):
    rows = table(spark, d, "events").select((F.when(F.col("event_id") % 10 == 0, F.lit(1)).otherwise(F.floor(F.col("event_id") / 400))).cast("long").alias("track"), F.col("event_id").alias("t"), F.lit(0.0).alias("x"))
    # The second track does not begin after the first one ends, so nothing moves.
    return tracks.join_tracks(rows, 1, 2).select("t", "track")


@register("z04_join_later_track", "select event_id as t, (case when event_id // 300 = 2 then 0 else event_id // 300 end)::bigint as track from events")
def _(spark, d):
    rows = table(spark, d, "events").select(F.floor(F.col("event_id") / 300).cast("long").alias("track"), F.col("event_id").alias("t"))
    return tracks.join_tracks(rows, 0, 2).select("t", "track")


@register("z05_polylines", "select user_id as track, count(*) as n, min(event_id) as first, arg_max(value, event_id) as last_x from events group by 1")
def _(spark, d):
    lines = tracks.as_polylines(track_rows(spark, d))
    return lines.select("track", F.size("points").cast("long").alias("n"), F.col("points")[0]["t"].alias("first"), F.element_at("points", -1)["x"].alias("last_x"))


@register("z06_track_classes", "select user_id as track, event_id as t, case when user_id % 2 = 0 then user_id % 4 end as class from events")
def _(spark, d):
    rows = track_rows(spark, d)
    classes = rows.select("track").distinct().where("track % 2 = 0").withColumn("class", F.col("track") % 4)
    return tracks.with_classes(rows, classes, by_time=False).select("track", "t", "class")


@register("a20_module_means", "with z as (select p_partkey, (p_size - avg(p_size) over ()) / stddev_samp(p_size) over () as a, (p_retailprice - avg(p_retailprice) over ()) / stddev_samp(p_retailprice) over () as b from part) select p_partkey, round((a + b) / 2, 6) as both, round(b, 6) as price from z")
def _(spark, d):
    return statistics.module_means(table(spark, d, "part"), "p_partkey", {"both": ["p_size", "p_retailprice"], "price": ["p_retailprice"]}).select("p_partkey", *r6("both", "price"))


@register("o07_group_order", "select p_brand, count(*) as n, round(avg(p_retailprice), 6) as mean, row_number() over (order by avg(p_retailprice), p_brand)::int as rank from part group by p_brand")
def _(spark, d):
    return statistics.group_order(table(spark, d, "part"), "p_brand", "p_retailprice").select("p_brand", "n", *r6("mean"), "rank")


@register("a16_average_histogram", "with e as (select min(p_retailprice) as lo, max(p_retailprice) as hi from part), c as (select p_brand as g, least(floor((p_retailprice - lo) / ((hi - lo) / 10)), 9)::int as bin, count(*)::double as c from part, e group by 1, 2), n as (select p_brand as g, count(*)::double as n from part group by 1) select bin, round(sum(c / n) / (select count(*) from n), 8) as share from c join n using (g) group by bin")
def _(spark, d):
    return statistics.average_histogram(table(spark, d, "part"), "p_retailprice", "p_brand").select("bin", F.round("share", 8).alias("share"))


@register("t10_combined_table", "select c_custkey as id, c_acctbal, coalesce(n, 0) as orders from customer left join (select o_custkey, count(*)::bigint as n from orders group by 1) on c_custkey = o_custkey")
def _(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("orders"))
    return spatial.attach(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), per, default=0)


@register("t12_rows_of_cluster", "select o_orderkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem where l_linenumber = 5)")
def _(spark, d):
    members = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("cluster_id"), F.col("l_orderkey").alias("object_id")).where("cluster_id = 5")
    return filters.keep_ids(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), clusters.all_selected(members).select(F.col("object_id").alias("o_orderkey")), "o_orderkey")


@register("a27_class_range", "select count(distinct label) as classes, min(label) as low, max(label) as high from embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").agg(F.count_distinct("label").alias("classes"), F.min("label").alias("low"), F.max("label").alias("high"))


@register("k05_upsert", "select p_partkey as cell_id, p_retailprice as area, 0.0::double as extra, 1::bigint as img_id, 'a' as img_location from part where p_partkey % 3 = 0 union all select p_partkey, p_retailprice, p_size / 2.0::double, 2, 'b' from part where p_partkey % 3 = 1")
def _(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("cell_id"), F.col("p_retailprice").alias("area"), (F.col("p_size") / 2).alias("extra"))
    old = tables.upsert_image(None, t.where("cell_id % 3 = 2").drop("extra"), "a")
    both = tables.upsert_image(old, t.where("cell_id % 3 = 1"), "b")
    return tables.upsert_image(both, t.where("cell_id % 3 = 0").drop("extra"), "a").select("cell_id", "area", "extra", "img_id", "img_location")


@register("x04_time_stamps", "select o_orderkey, strftime(o_orderdate, '%Y_%m_%d_%H_%M_%S') as stamp from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalar.time_stamp(F.col("o_orderdate")).alias("stamp"))


@register("x06_parts", "with p as (select p_partkey, list_filter(string_split(p_type, ' '), lambda x: x <> '') as w from part) select p_partkey, len(w)::int as n, w[1] as first, w[-1] as last from p")
def _(spark, d):
    w = scalar.parts_of(F.col("p_type"), " ")
    return table(spark, d, "part").select("p_partkey", F.size(w).alias("n"), F.get(w, F.lit(0)).alias("first"), F.element_at(w, -1).alias("last"))


@register("x_more_scalars", "with p as (select vec_id as id, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c from embeddings) select id, round(degrees(atan2(c, sqrt(a * a + b * b))), 6) as elevation, round(10 + 20 * (a + 1) / 2, 6) as rescaled, round(1 - a, 6) as inverted, round(least(a, b, c), 6) as smallest, round(greatest(a, b, c), 6) as largest, round(degrees(acos(c / sqrt(a * a + b * b + c * c))), 4) as angle, round(degrees(acos(least(greatest(b / sqrt(b * b + c * c), -1.0), 1.0))), 4) as plane_angle from p")
def _(spark, d):
    e = F.col("embedding")
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *(e[k].cast("double").alias(n) for k, n in enumerate("abc")))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    zero, one = F.lit(0.0), F.lit(1.0)
    axes = [[one, zero, zero], [zero, one, zero], [zero, zero, one]]
    return t.select(
        "id",
        F.round(scalar.elevation(a, b, c), 6).alias("elevation"),
        F.round(scalar.rescale(a, -1.0, 1.0, 10.0, 30.0), 6).alias("rescaled"),
        F.round(scalar.inverted(a, 1.0), 6).alias("inverted"),
        F.round(scalar.k_smallest(F.array(a, b, c), 1)[0], 6).alias("smallest"),
        F.round(scalar.k_largest(F.array(a, b, c), 1)[0], 6).alias("largest"),
        F.round(scalar.angle([a, b, c], axes[2]), 4).alias("angle"),
        # The plane of x and (a, b, c) against that of x and y.
        F.round(scalar.plane_angle(axes[0], [a, b, c], axes[0], axes[1]), 4).alias("plane_angle"),
    )


@register("x11_rall_power", "with g as (select p_partkey, 1 + p_size / 50.0::double as r from part), k as (select unnest(range(1, 5001)) as k), f as (select p_partkey, min(k) as k from g, k where abs(r ** (k / 1000.0::double) - 1 - 0.5::double ** (k / 1000.0::double)) <= 0.001 group by 1) select g.p_partkey, coalesce(k / 1000.0::double, -1.0::double) as power from g left join f on g.p_partkey = f.p_partkey")
def _(spark, d):
    r = 1 + F.col("p_size") / 50
    # A small file is a task or two, but each row is much work.
    return table(spark, d, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select("p_partkey", scalar.rall_power(r, F.lit(1.0), F.lit(0.5)).cast("double").alias("power"))


@register("c24_unmixed", "select vec_id as id, round(greatest(2 * embedding[1]::double - embedding[2]::double, 0), 6) as first, round(greatest(embedding[2]::double - embedding[1]::double, 0), 6) as second from embeddings")
def _(spark, d):
    t = learning.unmix(vectors(spark, d, 2), [[1.0, 1.0], [1.0, 2.0]])
    return t.select("id", F.round(F.col("abundance")[0], 6).alias("first"), F.round(F.col("abundance")[1], 6).alias("second"))


@register("c26_edge_accuracy", f"with e as ({_knn(k=2)}), t as (select vec_id as id, label as class, vec_id % 7 as tag from embeddings) select a.class, round(avg((abs(a.tag - b.tag) <= 2)::int::double), 6) as right_share from e join t a on a.id = e.source join t b on b.id = e.target where a.class <> b.class group by 1")
def _(spark, d):
    p = points(spark, d)
    tags = p.select("id", "class", (F.col("id") % 7).alias("tag"))
    return learning.edge_accuracy(spatial.nearest(p, p, 2), tags, 2).select("class", *r6("right_share"))


@register("k14_selected_features", "select p_partkey as id, round((p_size - avg(p_size) over ()) / stddev_samp(p_size) over (), 6) as p_size from part")
def _(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
    chosen = statistics.top_features(t.select(F.explode(F.array(F.struct(F.lit("p_size").alias("feature"), F.lit(2.0).alias("weight")), F.struct(F.lit("p_retailprice").alias("feature"), F.lit(-1.0).alias("weight")))).alias("w")).select("w.*").distinct(), 1)
    names = [r["feature"] for r in chosen.collect()]  # as many as were asked for
    return statistics.zscores(t.select("id", *names), names).select("id", *r6(*names))


@register("o01_sorted", "select row_number() over (order by p_retailprice, p_partkey)::int as place, p_partkey, p_retailprice from part order by p_retailprice, p_partkey limit 50")
def _(spark, d):
    t = filters.sorted_rows(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey").limit(50)
    return t.select(F.row_number().over(Window.orderBy("p_retailprice", "p_partkey")).alias("place"), "p_partkey", "p_retailprice")


def _similar(spark, d):
    p = points(spark, d)
    return learning.similarities(spatial.nearest(p, p, 5))


@register("c08_replicator")
def _(spark, d):
    return learning.replicator(_similar(spark, d))


@register("c10_diffusion_map")
def _(spark, d):
    return learning.diffusion_map(_similar(spark, d))


@register("j12_diffusion_neighbours")
def _(spark, d):
    c = F.col("coordinates")
    placed = learning.diffusion_map(_similar(spark, d)).select("id", *(c[k].alias(a) for k, a in enumerate("xyz")))
    return spatial.nearest(placed, placed, 3)


@register("i01_laplacian", f"{_V} select a.x, a.y, a.z, round({' + '.join(f'coalesce(n{k}.value - a.value, 0)' for k in range(6))}, 6)::double as value from v a {_JOINS}")
def _(spark, d):
    return voxels.laplacian(voxel_rows(spark, d).withColumn("value", F.col("value").cast("double"))).select("x", "y", "z", *r6("value"))


@register("i01_gaussian", f"{_V} select a.x, a.y, a.z, round(sum(exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 2.0) * b.value) / sum(exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 2.0)), 6) as value from v a join v b on b.x between a.x - 1 and a.x + 1 and b.y between a.y - 1 and a.y + 1 and b.z between a.z - 1 and a.z + 1 group by 1, 2, 3")
def _(spark, d):
    return voxels.gaussian(voxel_rows(spark, d), 1.0).select("x", "y", "z", *r6("value"))


@register("f13_added_object", f"{_V}, m as (select max(label) + 1 as free from v) select x, y, z, (case when label = 0 and (x - 8) ** 2 + (y - 8) ** 2 + (z - 3) ** 2 <= 25 then free else label end)::bigint as label from v, m")
def _(spark, d):
    return voxels.add_object(voxel_rows(spark, d), (8.0, 8.0, 3.0), 5.0).select("x", "y", "z", F.col("label").cast("long").alias("label"))


@register("z07_angles_to_device", f"{_P} select id, round(degrees(atan2(2 - y, 1 - x)), 5) as azimuth, round(degrees(atan2(-1 - z, sqrt((1 - x) ** 2 + (2 - y) ** 2))), 5) as elevation, round(sqrt((1 - x) ** 2 + (2 - y) ** 2 + (-1 - z) ** 2), 6) as distance from p")
def _(spark, d):
    t = spatial.angles_to(points(spark, d), (1.0, 2.0, -1.0))
    return t.select("id", F.round("azimuth", 5).alias("azimuth"), F.round("elevation", 5).alias("elevation"), *r6("distance"))


@register("x22_scaled_steps", f"{_TR} select track, t, round(sqrt(4 * dx * dx + dy * dy), 6) as step from s")
def _(spark, d):
    return tracks.steps(track_rows(spark, d), (2.0, 1.0, 3.0)).select("track", "t", *r6("step"))


@register("x07_letters", "with p as (select p_partkey, upper(substr(p_name, 1, 2)) as w from part) select p_partkey, ((ascii(w) - 64) * 26 + ascii(substr(w, 2)) - 64)::bigint as number from p")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.letters_to_number(F.substring("p_name", 1, 2)).alias("number"))
