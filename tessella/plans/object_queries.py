"""Registered queries over object tables: selection, sets, statistics, scaling, clusters, accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scalar
from tessella.operators import agglomeration, clusters, filters, learning, statistics
from tessella.operators.filters import Range
from tessella.plans.steps import Plan, query
from tessella.registry import register, table


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@register("f01_filter_left_to_right", "select p_partkey from part where (p_size between 10 and 30 or p_retailprice > 1500) and p_partkey % 7 between 0 and 3")
def _(spark, d):
    t = table(spark, d, "part").withColumn("m", F.col("p_partkey") % 7)
    return filters.select_ids(t, "p_partkey", [Range("p_size", 10, 30), Range("p_retailprice", -1e18, 1500, inside=False), Range("m", 0, 3)], ["OR", "AND"])


@register("f01_filter_outside", "select l_orderkey, l_linenumber from lineitem where l_quantity < 10 or l_quantity > 40")
def _(spark, d):
    return table(spark, d, "lineitem").where(Range("l_quantity", 10, 40, inside=False).test()).select("l_orderkey", "l_linenumber")


@register("f02_bounds", "select min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem")
def _(spark, d):
    return filters.bounds(table(spark, d, "lineitem"), "l_extendedprice")


@register("f04_columns_with", "select p_name, p_type, p_retailprice from part where p_size > 40")
def _(spark, d):
    t = table(spark, d, "part").where("p_size > 40")
    return filters.extract(t, ["p_name", "p_type"], always="price")


@register("f08_exclude_margin", "select vec_id from embeddings where embedding[1] between -0.2 and 0.2 and embedding[2] between -0.2 and 0.2 and embedding[3] between -0.1 and 0.3")
def _(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[k].alias(c) for k, c in enumerate("xyz")))
    return filters.exclude_margin(t, {"x": (-0.2, 0.2), "y": (-0.2, 0.2), "z": (-0.1, 0.3)}).select("vec_id")


@register("f07_extract_class", "select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings where label = 3")
def _(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")))
    return Plan().then("extract_class", column="label", value=3, columns=["vec_id", "x", "y", "z"]).run(t)


@register("f09_mask_attribute", "select o_orderkey, coalesce(m.v, 0) as roi from orders o left join (select n_nationkey as x, n_regionkey as y, n_nationkey * 10 as v from nation) m on floor(o_custkey % 25) = m.x and floor(o_custkey % 5) = m.y")
def _(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("x"), (F.col("o_custkey") % 5).alias("y"))
    mask = table(spark, d, "nation").select(F.col("n_nationkey").alias("x"), F.col("n_regionkey").alias("y"), (F.col("n_nationkey") * 10).alias("v"))
    return filters.mask_attribute(t, mask, "x", "y", "v").select("o_orderkey", "roi")


@register("f10_drop_ids", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)")
def _(spark, d):
    gone = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return filters.drop_ids(table(spark, d, "orders"), gone, "o_orderkey").select("o_orderkey")


@register("f11_blank_row", "select s_suppkey, s_name from supplier union all select max(s_suppkey) + 1, null from supplier")
def _(spark, d):
    return filters.with_blank_row(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")


@register("f12_merge_ids", "select case when s_suppkey % 3 = 1 then s_suppkey - 1 else s_suppkey end as s_suppkey, count(*) as n, round(sum(s_acctbal), 4) as total from supplier group by 1")
def _(spark, d):
    t = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    into = t.where("s_suppkey % 3 = 1").select("s_suppkey", (F.col("s_suppkey") - 1).alias("into"))
    return filters.merge_ids(t, into, "s_suppkey").groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 4).alias("total"))


@register("f14_change_class", "select o_orderkey, case when o_totalprice > 300000 then 'HIGH' else o_orderpriority end as o_orderpriority from orders")
def _(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return filters.set_where(t, "o_orderpriority", t.where("o_totalprice > 300000"), "o_orderkey", "HIGH").select("o_orderkey", "o_orderpriority")


@register("f17_zero_columns", "select p_partkey, p_size from part")
def _(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_size", F.lit(0).alias("a"), (F.col("p_size") * 0).alias("b"))
    return filters.without_zero_columns(t, ["p_size", "a", "b"])


_A, _B = "select l_orderkey as object_id from lineitem where l_quantity > 45", "select l_orderkey as object_id from lineitem where l_discount >= 0.09"


def _ab(spark, d):
    t = table(spark, d, "lineitem")
    return (t.where(c).select(F.col("l_orderkey").alias("object_id")) for c in ("l_quantity > 45", "l_discount >= 0.09"))


for _name, _op, _sql in (("t01_set_add", "ADD", f"{_A} union {_B}"), ("t02_set_subtract", "SUBTRACT", f"{_A} except {_B}"), ("t03_set_and", "AND", f"{_A} intersect {_B}"), ("t04_set_xor", "XOR", f"(({_A}) except ({_B})) union (({_B}) except ({_A}))")):
    register(_name, _sql)(lambda spark, d, op=_op: clusters.OPERATORS[op](*_ab(spark, d)))

_CLUSTERS = "select distinct l_linenumber as cluster_id, l_orderkey as object_id from lineitem"


def _clusters(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("cluster_id"), F.col("l_orderkey").alias("object_id")).distinct()


@register("t05_operate_override", f"with c as ({_CLUSTERS}) select * from c where cluster_id <> 1 union all (select 1, object_id from c where cluster_id = 1 except select 1, object_id from c where cluster_id = 3)")
def _(spark, d):
    return clusters.operate(_clusters(spark, d), 1, 3, "SUBTRACT", 1)


@register("t06_all_selected", "select distinct l_orderkey as object_id from lineitem")
def _(spark, d):
    return clusters.all_selected(_clusters(spark, d))


@register("t11_cluster_edits", f"with c as ({_CLUSTERS}) select * from c where not (cluster_id = 2 and object_id % 2 = 0) and cluster_id <> 4 union all select 8, object_id from c where cluster_id = 7 and object_id % 5 = 0")
def _(spark, d):
    c = _clusters(spark, d)
    more = c.where("cluster_id = 7 and object_id % 5 = 0").select("object_id")
    c = clusters.add_cluster(c, more)
    c = clusters.remove_from_cluster(c, 2, c.where("object_id % 2 = 0").select("object_id"))
    return clusters.remove_cluster(c, 4)


@register("t08_append_with_offset", "select p_partkey, p_retailprice from part union all select s_suppkey + (select max(p_partkey) + 1 from part), s_acctbal + 100.0 from supplier")
def _(spark, d):
    a, b = table(spark, d, "part").select("p_partkey", "p_retailprice"), table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return clusters.append_with_offset(a, b, "p_partkey", {"p_retailprice": 100.0})


@register("t09_mega_table", "select event_id, value, 0 as time from events where event_type = 'click' union all select event_id, value, 1 as time from events where event_type = 'view'")
def _(spark, d):
    e = table(spark, d, "events")
    return clusters.stacked({t: e.where(F.col("event_type") == k).select("event_id", "value") for t, k in enumerate(("click", "view"))})


@register("a13_column_statistics", "with l as (select unnest(['p_size', 'p_retailprice']) as name, unnest([p_size::double, p_retailprice]) as v from part), c as (select name, v, count(*) as c from l group by name, v), m as (select name, case when c > 1 then v end as mode from c qualify row_number() over (partition by name order by c desc, v) = 1) select l.name, count(v) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, min(v) as low, max(v) as high, median(v) as median, any_value(mode) as mode from l join m on l.name = m.name group by l.name")
def _(spark, d):
    return statistics.column_statistics(table(spark, d, "part"), ["p_size", "p_retailprice"]).select("name", "n", *r6("mean", "sd"), "low", "high", "median", "mode")


@register("a13_statistics_of_selection", "select 'l_tax' as name, count(l_tax) as n, round(avg(l_tax), 6) as mean, round(stddev_samp(l_tax), 6) as sd, min(l_tax) as low, max(l_tax) as high, median(l_tax) as median from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')")
def _(spark, d):
    chosen = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return statistics.column_statistics(filters.keep_ids(table(spark, d, "lineitem"), chosen, "l_orderkey"), ["l_tax"]).select("name", "n", *r6("mean", "sd"), "low", "high", "median")


_HIST = "with e as (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem) select least(floor((l_quantity - lo) / ((hi - lo) / 10)), 9)::int as bin, count(*) as n from lineitem, e {} group by 1"


@register("a15_histogram", _HIST.format(""))
def _(spark, d):
    return statistics.histogram(table(spark, d, "lineitem"), "l_quantity")


@register("a15_histogram_of_cluster", _HIST.format("where l_returnflag = 'R'"))
def _(spark, d):
    return statistics.histogram(table(spark, d, "lineitem"), "l_quantity", subset=F.col("l_returnflag") == "R")


@register("x24_log_counts", "select o_orderpriority, count(*) as n, round(case when count(*) > 1 then log10(count(*)) else count(*)::double end, 6) as log_n from orders group by 1")
def _(spark, d):
    return statistics.log_counts(table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))).select("o_orderpriority", "n", *r6("log_n"))


@register("a17_group_means", "select l_returnflag, round(avg(l_quantity), 6) as l_quantity, round(avg(l_extendedprice), 4) as l_extendedprice from lineitem group by 1")
def _(spark, d):
    t = Plan().then("group_means", by="l_returnflag", columns=["l_quantity", "l_extendedprice"]).run(table(spark, d, "lineitem"))
    return t.select("l_returnflag", *r6("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"))


@register("a18_cluster_sizes", f"select cluster_id, count(*) as objects from ({_CLUSTERS}) group by 1")
def _(spark, d):
    return clusters.sizes(_clusters(spark, d))


@register("a21_anova", "with l as (select p_brand as g, unnest(['p_size', 'p_retailprice']) as name, unnest([p_size::double, p_retailprice]) as v from part), p as (select name, g, count(*)::double as n, sum(v) as s, sum(v * v) as q from l group by name, g), t as (select name, sum(n) as nn, count(*)::double as gg, sum(s) as ss, sum(s * s / n) as b, sum(q) as q from p group by name), u as (select name, (b - ss * ss / nn) / (gg - 1) as msb, (q - b) / (nn - gg) as msw, nn / gg as k from t) select name, round(msb, 4) as msb, round(msw, 4) as msw, round((msb - msw) / (msb + (k - 1) * msw), 8) as icc from u")
def _(spark, d):
    t = statistics.anova(table(spark, d, "part"), "p_brand", ["p_size", "p_retailprice"])
    return t.select("name", F.round("msb", 4).alias("msb"), F.round("msw", 4).alias("msw"), F.round("icc", 8).alias("icc"))


@register("a22_share_within", "select o_orderpriority, round(avg((o_totalprice <= 150000)::int::double), 6) as share from orders group by 1")
def _(spark, d):
    return statistics.share_within(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", 150000).select("o_orderpriority", *r6("share"))


@register("w07_top_features", "select p_brand as feature, max(abs(p_size - 25)) as weight from part group by 1 order by weight desc, feature limit 5")
def _(spark, d):
    return statistics.top_features(table(spark, d, "part").select(F.col("p_brand").alias("feature"), (F.col("p_size") - 25).alias("weight")))


@register("w08_zscore", "select p_partkey, round((p_size - avg(p_size) over ()) / stddev_samp(p_size) over (), 6) as p_size from part")
def _(spark, d):
    return Plan().then("zscore", columns=["p_size"]).run(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", *r6("p_size"))


@register("w09_minmax", "select p_partkey, round(-1 + 2.0 * (p_retailprice - min(p_retailprice) over ()) / (max(p_retailprice) over () - min(p_retailprice) over ()), 6) as p_retailprice from part")
def _(spark, d):
    return statistics.minmax(table(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]).select("p_partkey", *r6("p_retailprice"))


@register("w10_share_at_threshold", "select round(avg((c_acctbal >= 5000 and c_acctbal > 0)::int::double), 6) as share from customer")
def _(spark, d):
    return statistics.approximate_share_lookup(table(spark, d, "customer"), "c_acctbal", 5000).select(*r6("share"))


@register("c11_emd", "with e as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem), h as (select least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19)::int as bin, sum((l_returnflag <> 'R')::int)::double as a, sum((l_returnflag = 'R')::int)::double as b from lineitem, e group by 1), r as (select sum(a) over (order by bin) / sum(a) over () - sum(b) over (order by bin) / sum(b) over () as d from h) select round(sum(abs(d)), 6) as emd from r")
def _(spark, d):
    t = table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").alias("side"))
    return statistics.emd(t, "l_extendedprice", "side").select(*r6("emd"))


@register("o08_argmax_softmax_classify", "with z as (select vec_id, embedding[1]::double / 0.1 as a, (embedding[2]::double - 0.01) / 0.2 as b from embeddings), s as (select vec_id, [0.1 + a - b, 0.5 * b, -0.2 - a] as s from z), p as (select vec_id, list_transform(s, lambda x: exp(x - list_max(s))) as e from s), q as (select vec_id, list_transform(e, lambda x: x / list_sum(e)) as p from p) select vec_id as id, case when list_max(p) > 0.5 then list_position(p, list_max(p)) else 0 end::int as prediction, round(list_max(p), 6) as confidence from q")
def _(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("v"))
    return learning.classify(points, [0.0, 0.01], [0.1, 0.2], [[0.1, 1.0, -1.0], [0.0, 0.0, 0.5], [-0.2, -1.0, 0.0]], 0.5).select("id", "prediction", *r6("confidence"))


def vectors(spark, d, dims=64):
    """id and embedding of every row, as doubles."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, dims), lambda x: x.cast("double")).alias("v"))


@register("c04_kmeans")
def _(spark, d):
    return learning.kmeans(vectors(spark, d), 10)


@register("c07_fuzzy_memberships", "with d as (select vec_id as id, [sqrt((embedding[1]::double - 0.1) * (embedding[1]::double - 0.1) + embedding[2]::double * embedding[2]::double), sqrt(embedding[1]::double * embedding[1]::double + (embedding[2]::double + 0.1) * (embedding[2]::double + 0.1))] as d from embeddings) select id, round(d[1] ** -2 / (d[1] ** -2 + d[2] ** -2), 6) as first, round(d[2] ** -2 / (d[1] ** -2 + d[2] ** -2), 6) as second from d")
def _(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("v"))
    m = learning.fuzzy_memberships(points, [[0.1, 0.0], [0.0, -0.1]])
    return m.select("id", F.round(F.col("membership")[0], 6).alias("first"), F.round(F.col("membership")[1], 6).alias("second"))


@register("c22_stratified_estimate", "with p as (select label, count(*)::double as nn, sum((vec_id % 5 = 0)::int)::double as n, sum((vec_id % 5 = 0 and embedding[1] > 0)::int)::double as h from embeddings group by label), q as (select *, case when n > 0 then 1 / sqrt(n) else 2.0 end as m from p), e as (select nn, (h + m / 2) / (n + m) as p, n from q), v as (select nn, p, p * (1 - p) / greatest(n, 1) * case when nn > 1 then (nn - n) / (nn - 1) else 0 end as v from e) select round(sum(nn * p) / sum(nn), 6) as accuracy, round(sum(nn * nn * v) / (sum(nn) * sum(nn)), 8) as variance from v")
def _(spark, d):
    t = learning.stratified_estimate(table(spark, d, "embeddings"), "label", F.col("vec_id") % 5 == 0, F.col("embedding")[0] > 0)
    return t.select(F.round("accuracy", 6).alias("accuracy"), F.round("variance", 8).alias("variance"))


@register("c22_allocation", "select label, count(*) as N, ceil(round(0.15 * count(*) * 1.96 * sqrt(avg((embedding[1] > 0)::int::double) * (1 - avg((embedding[1] > 0)::int::double))), 9))::bigint as draw from embeddings group by label")
def _(spark, d):
    return learning.allocation(table(spark, d, "embeddings"), "label", F.col("embedding")[0] > 0)


@register("c01_agglomerative")
def _(spark, d):
    return agglomeration.mergers(vectors(spark, d))[1]


@register("c19_outliers", "with l as (select vec_id as id, unnest(range(1, 65)) as d, unnest(embedding)::double as x from embeddings), m as (select d, quantile_disc(x, 0.5) as m, stddev_pop(x) as s from l group by d), s as (select id, sqrt(sum(case when s > 0 then ((x - m) / s) ** 2 else 0 end)) as score from l join m on l.d = m.d group by id) select id, round(score, 5) as score, (score > (select quantile_disc(score, 0.9) from s))::int as outlier from s")
def _(spark, d):
    return learning.isolation(vectors(spark, d)).select("id", F.round("score", 5).alias("score"), "outlier")


@register("x03_paths", "select page_id, regexp_extract(url, '\\.([^./\\\\]*)$', 1) as ext, regexp_extract(url, '^(.*)[/\\\\][^/\\\\]*$', 1) as folder, regexp_extract(url, '([^/\\\\]*)$', 1) as file from pages")
def _(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", scalar.extension(u).alias("ext"), scalar.folder(u).alias("folder"), scalar.file_name(u).alias("file"))


@register("x_scalars", "select p_partkey, printf('%.2f', p_retailprice) as fixed, upper(p_brand) as capitals, round(degrees(atan2(p_size - 25.0, p_retailprice - 1000)), 6) as azimuth, round(exp(-(p_size * p_size)::double / 200), 8) as kernel, round(1 / (1 + exp(-(p_size - 25.0) / 5)), 8) as sig, case when p_size between 10 and 20 then 1.0 else 0.0 end::double as hit, round((sqrt(p_size) ** 1.5 + 2.0 ** 1.5) / 3.0 ** 1.5, 6) as pk from part")
def _(spark, d):
    s = F.col("p_size").cast("double")
    return table(spark, d, "part").select(
        "p_partkey",
        scalar.fixed(F.col("p_retailprice"), 2).alias("fixed"),
        scalar.capitals(F.col("p_brand")).alias("capitals"),
        F.round(scalar.azimuth(F.col("p_retailprice") - 1000, s - 25), 6).alias("azimuth"),
        F.round(scalar.gaussian(s * s, 10.0), 8).alias("kernel"),
        F.round(scalar.sigmoid(s, 5.0, 25.0), 8).alias("sig"),
        scalar.threshold(s, 10, 20, 1.0, 0.0).alias("hit"),
        F.round(scalar.pk(F.lit(3.0), F.sqrt(s), F.lit(2.0), 1.5), 6).alias("pk"),
    )


@register("x18_block_distances", "select vec_id, round(list_sum(list_transform(range(1, 9), lambda i: abs(embedding[i]::double - embedding[i + 8]::double))), 6) as l1, round(sqrt(list_sum(list_transform(range(1, 9), lambda i: (embedding[i]::double - embedding[i + 8]::double) ** 2))), 6) as l2 from embeddings")
def _(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    a, b = F.slice(v, 1, 8), F.slice(v, 9, 8)
    return table(spark, d, "embeddings").select("vec_id", F.round(scalar.city_block(a, b), 6).alias("l1"), F.round(scalar.euclidean(a, b), 6).alias("l2"))


@register("k05_schema_evolution", "select p_partkey, p_retailprice, 0.0 as extra from part where p_partkey % 2 = 0 union all select p_partkey, p_retailprice, p_size / 2.0 from part where p_partkey % 2 = 1")
def _(spark, d):
    t = table(spark, d, "part")
    old = t.where("p_partkey % 2 = 0").select("p_partkey", "p_retailprice")
    new = t.where("p_partkey % 2 = 1").select("p_partkey", "p_retailprice", (F.col("p_size") / 2).alias("extra"))
    return old.unionByName(new, allowMissingColumns=True).na.fill(0.0)


@register("f26_sql_step", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' and o_custkey % 10 = 3")
def _(spark, d):
    return query(spark, "select o_orderkey, o_totalprice from objects where o_orderstatus = :status and o_custkey % 10 = :n", {"objects": table(spark, d, "orders")}, {"status": "O", "n": 3})


@register("a29_count", "select count(*) as n from lineitem where l_quantity > 25")
def _(spark, d):
    return query(spark, "select count(*) as n from objects where l_quantity > :q", {"objects": table(spark, d, "lineitem")}, {"q": 25})
