"""Progression similarity: how far the neighbourhoods of one feature follow another feature.

In a context feature, the distances along the neighbour graph of another one lie somewhere between those of the context's own graph and those
of a graph without any order, or beyond these towards the farthest pairs. Histograms of all distances, for all pairs
of features, are one aggregation over edges and contexts, and earth mover's distances between them place each feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.operators import spatial
from tessella.operators.graph import kept


def noise(key: Column) -> Column:
    """A number in [0, 1) by hash, the feature without any order."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(2.0**48)


def _graphs(long: DataFrame, k: int, features: int) -> DataFrame:
    """f, source and target: each row's k nearest by the feature, ties to the smaller id."""
    placed = long.select((F.col("id") * (features + 1) + F.col("f")).alias("id"), F.col("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), "f")
    edges = spatial.nearest(placed, placed, k, by="f")
    of = lambda c: F.floor(F.col(c) / (features + 1)).cast("long")
    return edges.select(F.pmod("source", F.lit(features + 1)).cast("int").alias("f"), of("source").alias("source"), of("target").alias("target"), "distance", "rank")


def _farthest(long: DataFrame, k: int) -> DataFrame:
    """f, source and target: each row's k farthest by the feature, ties to the smaller id; they are among the k + 1 least and largest rows."""
    low, high = Window.partitionBy("f").orderBy("x", "id"), Window.partitionBy("f").orderBy(F.col("x").desc(), "id")
    ends = [long.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1).drop("_n") for w in (low, high)]
    ends = kept(ends[0].unionByName(ends[1]).distinct())
    pairs = long.select("f", F.col("id").alias("source"), "x").join(ends.select("f", F.col("id").alias("target"), F.col("x").alias("_x")), "f").where("source <> target")
    far = Window.partitionBy("f", "source").orderBy(F.abs(F.col("x") - F.col("_x")).desc(), "target")
    return pairs.withColumn("_n", F.row_number().over(far)).where(F.col("_n") <= k).select("f", "source", "target")


def similarity(points: DataFrame, k: int = 5, bins: int = 20) -> DataFrame:
    """context, feature and score of every ordered pair of the features in `v` of points (id, v); ids are whole and not negative.

    The score is the earth moved from the noise graph's histogram to the feature's, over that to the context's own graph if the feature's distances are
    smaller than those of noise on the whole, else over that to the farthest pairs. So a feature scores 1 in its own context. A constant feature scores 0 in every context, and all score 0 in its.
    """
    points = kept(points.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")))
    one = points.select(F.size("v").alias("n")).limit(1).collect()
    if not one:
        return points.sparkSession.createDataFrame([], "context int, feature int, score double")
    features = one[0]["n"]
    long = kept(points.select("id", F.posexplode("v").alias("f", "x")))
    with_noise = long.unionByName(points.select("id", F.lit(features).alias("f"), noise(F.col("id")).alias("x")))
    graphs = kept(_graphs(with_noise, k, features))
    # One row a feature: the range of its distances between rows.
    spans = long.groupBy("f").agg((F.max("x") - F.min("x")).alias("high")).join(graphs.where("rank = 1").groupBy("f").agg(F.min("distance").alias("low")), "f").collect()
    low, step = [0.0] * features, [0.0] * features
    for r in spans:
        low[r["f"]], step[r["f"]] = r["low"], (r["high"] - r["low"]) / bins
    flat = [c for c in range(features) if step[c] <= 1e-6]
    far = _farthest(long, k).select((F.col("f") + features + 1).alias("f"), "source", "target")
    edges = graphs.select("f", "source", "target").unionByName(far)
    a, b = (points.select(F.col("id").alias(end), F.col("v").alias(f"_{end}")) for end in ("source", "target"))
    told = edges.join(a, "source").join(b, "target").select("f", F.posexplode(F.zip_with("_source", "_target", lambda p, q: F.abs(p - q))).alias("c", "w"))
    # The farthest pairs of a feature count in its own context only.
    told = told.where((F.col("f") <= features) | (F.col("f") == F.col("c") + features + 1))
    told = told.withColumns({"_low": F.element_at(F.array(*map(F.lit, low)), F.col("c") + 1), "_step": F.element_at(F.array(*map(F.lit, step)), F.col("c") + 1)}).where(F.col("_step") > 1e-6)
    place = F.least(F.greatest(F.floor((F.col("w") - F.col("_low")) / F.col("_step")), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = told.groupBy("f", "c", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # From here on at most `bins` rows for each pair of features.
    grid = counts.select("f", "c").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    rising = Window.partitionBy("f", "c").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("f", "c")
    shares = grid.join(counts, ["f", "c", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    shares = kept(shares.select("f", "c", "bin", (F.sum("n").over(rising) / F.sum("n").over(whole)).alias("share")))
    of = lambda which, name: shares.where(which).select("c", "bin", F.col("share").alias(name))
    met = shares.where(F.col("f") < features).join(of(F.col("f") == features, "_noise"), ["c", "bin"]).join(of(F.col("f") == F.col("c"), "_near"), ["c", "bin"]).join(of(F.col("f") > features, "_far"), ["c", "bin"])
    moved = lambda p, q: F.sum(F.abs(F.col(p) - F.col(q)))
    sums = met.groupBy("c", "f").agg(moved("share", "_noise").alias("moved"), F.sum(F.col("share") - F.col("_noise")).alias("nearer"), moved("_noise", "_near").alias("to_near"), moved("_noise", "_far").alias("to_far"))
    base = F.when(F.col("nearer") >= 0, F.col("to_near")).otherwise(F.col("to_far"))
    found = sums.select(F.col("c").alias("context"), F.col("f").alias("feature"), F.when(base > 0, F.col("moved") / base).otherwise(F.lit(0.0)).alias("score"))
    names = points.sparkSession.range(features).select(F.col("id").cast("int").alias("context"))
    pairs = names.withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(features - 1))))
    constant = F.col("feature").isin(flat) | F.col("context").isin(flat) if flat else F.lit(False)
    return pairs.join(found, ["context", "feature"], "left").select("context", "feature", F.when(constant, F.lit(0.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))
