"""Registered queries over trace lines, trees and graphs, image frames and voxel parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import graph, learning, spatial, statistics, traces, voxels
from tessella.plans.object_queries import vectors
from tessella.plans.structure_queries import _D, _KE, _NODES, _P, _TREE, _V, _forest, _knn, points, tree, voxel_rows
from tessella.registry import register, table

_LINES = f"with recursive {_NODES}, k as (select parent, count(*) as kids from s where parent >= 0 group by parent), st as (select s.*, (s.parent < 0 or k.kids > 1) as start from s left join k on s.parent = k.parent), l as (select id, id as line, 0 as position from st where start union all select st.id, l.line, l.position + 1 from st join l on st.parent = l.id where not st.start), g as (select a.id, coalesce(sqrt((a.x - p.x) ** 2 + (a.y - p.y) ** 2 + (a.z - p.z) ** 2), 0) as step from s a left join s p on a.parent = p.id), ln as (select line, count(*) as size, sum(case when position > 0 then step else 0 end) as length, max(case when position = 0 then step end) as to_parent, arg_max(k.kids is null, position) as leaf, sqrt((arg_max(x, position) - arg_min(x, position)) ** 2 + (arg_max(y, position) - arg_min(y, position)) ** 2 + (arg_max(z, position) - arg_min(z, position)) ** 2) as euclid from l join s using (id) join g using (id) left join k on k.parent = l.id group by line), u as (select *, case when size > 1 and length > 0 then size / length else 1 end as density from ln)"


# Every object voxel with its six face neighbours.
_SIDES = [(c, s) for c in "xyz" for s in (1, -1)]
_JOINS = " ".join(f"left join v n{k} on " + " and ".join(f"n{k}.{a} = a.{a}" + (f" + {s}" if a == c else "") for a in "xyz") for k, (c, s) in enumerate(_SIDES))
_FACES = " + ".join(f"(n{k}.label is null or n{k}.label <> a.label)::int" for k in range(6))
_TOUCH = " + ".join(f"coalesce(n{k}.label <> a.label and n{k}.label <> 0, false)::int" for k in range(6))
_GRADIENT = " + ".join(f"coalesce((n{k}.value - n{k + 1}.value) / 2.0, 0) ** 2" for k in (0, 2, 4))
_SIX = f"{_V}, f as (select a.label, a.value, {_FACES} as faces, {_TOUCH} as touching, sqrt({_GRADIENT}) as g from v a {_JOINS} where a.label <> 0)"


@register("x15_fragmentation", f"{_LINES} select line, round(case when euclid > 0 then length / euclid end, 5) as fragmentation, round(to_parent, 6) as to_parent from u")
def _(spark, d):
    return traces.line_table(tree(spark, d)).select("line", F.round("tortuosity", 5).alias("fragmentation"), F.round("to_parent", 6).alias("to_parent"))


@register("f18_line_table", f"{_LINES} select line, size, round(length, 5) as length, round(euclid, 5) as euclid, round(density, 6) as density, round(to_parent, 6) as to_parent, leaf from u")
def _(spark, d):
    t = traces.line_table(tree(spark, d))
    return t.select("line", "size", F.round("length", 5).alias("length"), F.round("euclid", 5).alias("euclid"), F.round("density", 6).alias("density"), F.round("to_parent", 6).alias("to_parent"), "leaf")


for _name, _sql, _pick in (
    ("f18_short_lines", "size <= 2 and leaf", lambda t: traces.short_lines(t, 2)),
    ("f19_false_spines", "size <= 3 and length <= 5 and leaf", lambda t: traces.false_spines(t, 3, 5.0)),
    ("f20_false_bridges", "size <= 4 and density <= 1 and not leaf", lambda t: traces.false_bridges(t, 4)),
    ("f21_half_bridges", "size <= 4 and to_parent >= 4", lambda t: traces.half_bridges(t, 4, 4.0)),
):
    register(_name, f"{_LINES} select line, size from u where {_sql}")(lambda spark, d, pick=_pick: pick(traces.line_table(tree(spark, d))).select("line", "size"))


@register("g11_without_lines", f"{_LINES} select s.id, s.parent from s join l using (id) where line not in (select line from u where size <= 1 and leaf)")
def _(spark, d):
    t = tree(spark, d)
    return traces.without_lines(t, traces.short_lines(traces.line_table(t), 1)).select("id", "parent")


@register("g11_exploded", f"with {_NODES}, k as (select parent, count(*) as kids from s where parent >= 0 group by parent) select s.id, (case when k.kids = 1 then s.parent else -1 end)::bigint as parent from s left join k on s.parent = k.parent")
def _(spark, d):
    return traces.exploded(tree(spark, d)).select("id", "parent")


@register("g10_leaf_counts", f"with recursive {_TREE}, a as (select id as node, id as leaf from n where id not in (select parent from n) union all select n.parent, a.leaf from a join n on a.node = n.id where n.parent >= 0) select node as id, count(*) as leaves from a group by node")
def _(spark, d):
    return graph.leaf_counts(tree(spark, d))


@register("g07_backbone")
def _(spark, d):
    return graph.backbone(tree(spark, d))


@register("g08_cycle_rank", f"with recursive {_KE}, e as (select s, t from k union select t, s from k), r as (select vec_id as id, vec_id as c from embeddings union select e.t, r.c from r join e on e.s = r.id), l as (select id, min(c) as component from r group by id), v as (select component, count(*) as vertices from l group by 1), n as (select component, count(*) as edges from k join l on k.s = l.id group by 1) select component, vertices, coalesce(edges, 0) as edges, coalesce(edges, 0) - vertices + 1 as cycles from v left join n using (component)")
def _(spark, d):
    p = points(spark, d)
    return graph.cycle_rank(p, graph.kept(spatial.nearest(p, p, 2)))


@register("g08_chords", f"{_forest(3)} select s as source, t as target, round(w, 6) as distance from e where exists (select 1 from h where h.r = e.r and h.node = e.t)")
def _(spark, d):
    p = points(spark, d)
    return graph.chords(p, graph.kept(spatial.nearest(p, p, 3))).select("source", "target", F.round("distance", 6).alias("distance"))


@register("g04_subgraph", f"select source, target, round(distance, 6) as distance from ({_knn(k=3)}) where source % 3 = 0 and target % 3 = 0")
def _(spark, d):
    p = points(spark, d)
    return graph.subgraph(spatial.nearest(p, p, 3).select("source", "target", F.round("distance", 6).alias("distance")), p.where("id % 3 = 0"))


@register("g14_colouring")
def _(spark, d):
    p = points(spark, d)
    return graph.colouring(p, graph.kept(spatial.nearest(p, p, 4)))


@register("j28_voronoi", f"{_P} select a.id, arg_min(b.id, struct_pack(d := {_D}, i := -b.id)) as seed, round(min({_D}), 6) as distance from p a cross join p b where a.class > 0 and b.class = 0 group by a.id")
def _(spark, d):
    p = points(spark, d)
    return spatial.voronoi(p.where("class > 0"), p.where("class = 0")).select("id", "seed", F.round("distance", 6).alias("distance"))


@register("c21_density", f"with n as ({_knn()}), w as (select source, max(distance) as width from n group by source) select w.source as id, round(width, 6) as width, round(sum(exp(-distance * distance / (2 * width * width))) / any_value(width) ** 3, 4) as density from n join w using (source) group by w.source, width")
def _(spark, d):
    return spatial.density(points(spark, d), 5).select("id", F.round("width", 6).alias("width"), F.round("density", 4).alias("density"))


@register("j26_transformed", f"{_P} select id, round(0.5 * x - y + 3, 6) as x, round(y + 2 * z - 1, 6) as y, round(x + z, 6) as z from p")
def _(spark, d):
    t = spatial.transformed(points(spark, d), [[0.5, -1, 0, 3], [0, 1, 2, -1], [1, 0, 1, 0]])
    return t.select("id", *(F.round(c, 6).alias(c) for c in "xyz"))


@register("j27_to_anchor", "with recursive w as (select 0 as image, 0.0::double as dx, 0.0::double as dy, 0 as steps union all select n_nationkey, w.dx + n_nationkey, w.dy + 1, steps + 1 from nation join w on n_nationkey // 2 = w.image and n_nationkey > 0) select image, dx, dy, steps from w")
def _(spark, d):
    k = F.col("n_nationkey")
    one, zero = F.lit(1.0), F.lit(0.0)
    pairs = table(spark, d, "nation").where("n_nationkey > 0").select(k.alias("source"), F.floor(k / 2).cast("int").alias("target"), F.array(one, zero, zero, k.cast("double"), zero, one, zero, one, zero, zero, one, zero).alias("matrix"))
    return spatial.to_anchor(pairs, 0).select("image", F.col("matrix")[3].alias("dx"), F.col("matrix")[7].alias("dy"), "steps")


@register("j15_attach", "select c_custkey as id, coalesce(sum(o_totalprice), 0) > 0 as buys, count(o_orderkey) as orders from customer left join orders on c_custkey = o_custkey group by 1")
def _(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("spent"), F.count(F.lit(1)).alias("orders"))
    t = spatial.attach(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), per, default=0)
    return t.select("id", (F.col("spent") > 0).alias("buys"), "orders")


@register("j24_nearest_of_class", f"{_P} select a.id, round(min({_D}), 6) as distance from p a left join p b on a.id <> b.id and b.class = 4 and {_D} <= 0.9 group by a.id")
def _(spark, d):
    return spatial.nearest_of_class(points(spark, d), 4, 0.9).select("id", F.round("distance", 6).alias("distance"))


@register("w10_share_threshold", "select round(quantile_cont(c_acctbal, 0.75), 6) as threshold from customer where c_acctbal > 0")
def _(spark, d):
    return statistics.share_threshold(table(spark, d, "customer"), "c_acctbal", 0.25).select(F.round("threshold", 6).alias("threshold"))


@register("a16_interval_histogram", "select case when l_quantity >= 40 then 3 when l_quantity >= 25 then 2 when l_quantity >= 10 then 1 else 0 end as bin, count(*) as n from lineitem where l_quantity between 5 and 50 group by 1")
def _(spark, d):
    return statistics.interval_histogram(table(spark, d, "lineitem"), "l_quantity", [5, 10, 25, 40, 50])


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for k, a in enumerate(_FEATURES) for b in _FEATURES[k + 1 :]]


@register("c09_correlations", " union all ".join(f"select '{a}' as feature_1, '{b}' as feature_2, round(corr({a}, {b}), 6) as r from lineitem" for a, b in _PAIRS))
def _(spark, d):
    return statistics.correlations(table(spark, d, "lineitem"), _FEATURES).select("feature_1", "feature_2", F.round("r", 6).alias("r"))


@register("c09_feature_modules", "select unnest(['l_quantity', 'l_extendedprice', 'net', 'l_tax']) as feature, unnest([0, 1, 1, 2]) as module")
def _(spark, d):
    t = table(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return statistics.feature_modules(t, ["l_quantity", "l_extendedprice", "net", "l_tax"], 0.8)


@register("c02_cut_mergers")
def _(spark, d):
    cells, mergers = learning.cell_mergers(vectors(spark, d), linkage="complete")
    return cells.join(learning.cut_mergers(mergers, "g", 4), "member").select("id", "cluster")


@register("c03_elbow")
def _(spark, d):
    return learning.elbow(learning.cell_mergers(vectors(spark, d), linkage="complete")[1], "g")


@register("c17_batch_query", "select p_partkey as id, round(1 / abs(2 * p_retailprice / 3000 - 1), 6) as score from part order by 1 / abs(2 * p_retailprice / 3000 - 1) desc, p_partkey limit 20")
def _(spark, d):
    p = F.col("p_retailprice") / 3000
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(p, 1 - p).alias("p"))
    return learning.batch_query(t, 20).select("id", F.round("score", 6).alias("score"))


@register("c23_training_rows", "select p_partkey as id, case when p_partkey % 3 = 0 then 2 else 1 end as train_default from part where p_partkey % 2 = 0 or p_partkey % 3 = 0")
def _(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return learning.with_training(t.where("id % 2 = 0").withColumn("train_default", F.lit(1)), t.where("id % 3 = 0").withColumn("train_default", F.lit(2)))


@register("f13_split_by_seeds", f"{_V}, m as (select max(label) as top from v) select x, y, z, (case when label <> 3 then label when (x - 5) ** 2 + (y - 5) ** 2 + z ** 2 <= (x - 15) ** 2 + (y - 10) ** 2 + (z - 4) ** 2 then 3 else top + 1 end)::bigint as label from v, m")
def _(spark, d):
    return voxels.split_by_seeds(voxel_rows(spark, d), 3, [(5, 5, 0), (15, 10, 4)]).select("x", "y", "z", "label")


@register("f13_split_along_z", f"{_V}, m as (select max(label) + 1 as free from v) select x, y, z, (case when label = 2 and z >= 5 then free else label end)::bigint as label from v, m")
def _(spark, d):
    return voxels.split_along_z(voxel_rows(spark, d), 2, 5).select("x", "y", "z", "label")


@register("a26_roi_statistics", f"{_V} select 0 as t, 0 as ch, count(*) as n, min(value)::double as low, max(value)::double as high, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sigma, round(var_samp(value), 4) as variance from v where (x - 10) ** 2 + (y - 9) ** 2 <= 30")
def _(spark, d):
    t = voxels.roi_statistics(voxel_rows(spark, d), 10, 9, 30**0.5 + 1e-9)
    return t.select("t", "ch", "n", "low", "high", F.round("mean", 6).alias("mean"), F.round("sigma", 6).alias("sigma"), F.round("variance", 4).alias("variance"))


@register("i07_touching_border", f"{_V} select distinct label from v where label <> 0 and (y in (0, 19) or x in (0, 19))")
def _(spark, d):
    return voxels.touching_border(voxel_rows(spark, d), (10_000, 20, 20))


@register("i01_mean_filter", f"{_V} select a.x, a.y, a.z, round(avg(b.value), 6) as value from v a join v b on abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 and a.z - b.z between -1 and 1 group by 1, 2, 3")
def _(spark, d):
    return voxels.neighbourhood(voxel_rows(spark, d), "mean").select("x", "y", "z", F.round("value", 6).alias("value"))


@register("i02_otsu", f"{_V}, c as (select value::double as value, count(*) as n from v group by 1), r as (select value, sum(n) over (order by value) as w, sum(n * value) over (order by value) as s, sum(n) over () as ww, sum(n * value) over () as ss from c), q as (select value, case when ww > w then w::double * (ww - w) * (s / w - (ss - s) / (ww - w)) ** 2 else 0 end as b from r) select value as threshold from q order by b desc, value limit 1")
def _(spark, d):
    return voxels.otsu(voxel_rows(spark, d))


@register("a06_gradients", f"{_SIX} select label, round(coalesce(avg(case when faces > 0 then g end), 0), 6) as surface_gradient, round(coalesce(avg(case when faces = 0 then g end), 0), 6) as interior_gradient from f group by label")
def _(spark, d):
    return voxels.gradients(voxel_rows(spark, d)).select("label", F.round("surface_gradient", 6).alias("surface_gradient"), F.round("interior_gradient", 6).alias("interior_gradient"))


@register("a07_voxel_boundary", f"{_SIX}, p as (select label, count(*)::double as n, sum(faces)::bigint as surface_area, sum(touching)::double as touching, avg(case when faces > 0 then value end) as si, coalesce(avg(case when faces = 0 then value end), 0) as ii from f group by label) select label, surface_area, round(surface_area::double ** 3 / (36 * pi() * n * n), 4) as shape, round(si, 6) as surface_intensity, round(ii, 6) as interior_intensity, round(case when ii > 0 then si / ii else 0 end, 6) as intensity_ratio, round(case when surface_area > 0 then touching / surface_area else 0 end, 6) as shared_boundary from p")
def _(spark, d):
    t = voxels.boundary_features(voxel_rows(spark, d))
    rounded = ("surface_intensity", "interior_intensity", "intensity_ratio", "shared_boundary")
    return t.select("label", "surface_area", F.round("shape", 4).alias("shape"), *(F.round(c, 6).alias(c) for c in rounded))


@register("a10_shell_total", f"{_V}, o as (select distinct b.label, a.x, a.y, a.z, a.value from v a join v b on abs(a.x - b.x) <= 2 and abs(a.y - b.y) <= 2 and a.z - b.z between -2 and 2 and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 4 where b.label <> 0 and a.label <> b.label) select l.label, coalesce(sum(case when value >= 20 then value end), 0)::double as measure from (select distinct label from v where label <> 0) l left join o using (label) group by l.label")
def _(spark, d):
    v = voxel_rows(spark, d)
    return voxels.shell_association(v, v, 2, "TOTAL", 20)
