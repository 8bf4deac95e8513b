"""Nearest points through a tree of cells: what is far is looked at coarsely, whatever the points' density.

A cell holds the box of its points, which it halves along each axis for its children, so that clusters are reached in few levels wherever they
lie. A source goes down with the cells that may hold one of its nearest points: those whose box begins
no farther than the kth point surely lies, by the far ends of the boxes. Each level is a join by cell and a window over a source's
few cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.operators.graph import kept, unbroadcast

AXES = ("x", "y", "z")
#: Points of a cell that isn't divided.
LEAF = 64


def build(points: DataFrame, leaf: int = LEAF, rows: int = 0) -> tuple[list[DataFrame], DataFrame]:
    """The cells of each level - _by, path, parent, n, box, whether a leaf, least and largest `_label` - and the points with the path of their leaf.

    `points` has id, x, y, z, _by (each value has a tree of its own) and _label; `rows` is their number, if known.
    """
    open_ = points.withColumn("path", F.lit(""))
    levels, placed = [], []
    while True:
        box = {f"{side}{c}": f(c) for c in AXES for side, f in (("lo", F.min), ("hi", F.max))}
        cells = open_.groupBy("_by", "path").agg(F.count(F.lit(1)).alias("n"), F.min("_label").alias("least"), F.max("_label").alias("most"), *(v.alias(k) for k, v in box.items()))
        flat = reduce(lambda a, b: a & b, (F.col(f"lo{c}") == F.col(f"hi{c}") for c in AXES))
        cells = kept(cells.withColumns({"leaf": (F.col("n") <= leaf) | flat, "parent": F.expr("substring(path, 1, length(path) - 1)")}))
        levels.append(cells)
        told = open_.join(unbroadcast(cells.select("_by", "path", "leaf", *box), rows), ["_by", "path"])
        half = sum(F.when(F.col(c) - F.col(f"lo{c}") > (F.col(f"hi{c}") - F.col(f"lo{c}")) / 2, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(AXES))
        if cells.where(~F.col("leaf")).isEmpty():
            placed.append(told.drop("leaf", *box))
            return levels, reduce(DataFrame.unionByName, placed)
        told = kept(told.withColumn("next", F.when(~F.col("leaf"), F.concat("path", half.cast("string")))).drop("leaf", *box))
        placed.append(told.where("next is null").drop("next"))
        open_ = told.where("next is not null").drop("path").withColumnRenamed("next", "path")


def _reach() -> tuple[Column, Column]:
    """Squared distances from a source to the nearest and the farthest place of a box."""
    near = sum(F.pow(F.greatest(F.col(f"lo{c}") - F.col(f"s{c}"), F.col(f"s{c}") - F.col(f"hi{c}"), F.lit(0.0)), F.lit(2.0)) for c in AXES)
    far = sum(F.pow(F.greatest(F.col(f"s{c}") - F.col(f"lo{c}"), F.col(f"hi{c}") - F.col(f"s{c}")), F.lit(2.0)) for c in AXES)
    return near, far


def search(sources: DataFrame, levels: list[DataFrame], points: DataFrame, k: int, unlike: bool = False, once: bool = False, rows: int = 0) -> DataFrame:
    """source, target, distance and rank of each source's k nearest points, itself excluded, ties to the smaller id.

    `sources` has id, x, y, z, _by and _label. With `unlike` (for k = 1), only points of another label count; `once` returns a label's best
    sources only, those that are no farther from another label than the label's least distance surely is. `rows` is the number of points or
    sources, if known.
    """
    asked = sources.select(F.col("id").alias("source"), F.col("_label").alias("_own"), "_by", *(F.col(c).cast("double").alias(f"s{c}") for c in AXES))
    mine = asked.columns
    box = [f"{side}{c}" for c in AXES for side in ("lo", "hi")]
    open_, leaves = asked.withColumn("parent", F.lit("")), None
    near, far = _reach()
    for depth, cells in enumerate(levels):
        met = unbroadcast(open_, rows).join(unbroadcast(cells.select("_by", "parent", "path", "n", "leaf", "least", "most", *box), rows), ["_by", "parent"]) if depth else open_.join(cells.select("_by", "path", "n", "leaf", "least", "most", *box), "_by")
        if unlike:
            met = met.where((F.col("least") != F.col("_own")) | (F.col("most") != F.col("_own"))).withColumn("n", F.lit(1).cast("long"))
        met = met.select(*mine, "path", "n", "leaf", near.alias("near"), far.alias("far"))
        if leaves is not None:
            met = met.unionByName(leaves)
        by_far = Window.partitionBy("source").orderBy("far").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy("source")
        enough = F.when(F.sum("n").over(by_far) >= (1 if unlike else k + 1), F.col("far"))
        told = met.withColumn("_enough", enough).withColumn("_sure", F.min("_enough").over(whole))
        told = told.where(F.col("_sure").isNull() | (F.col("near") <= F.col("_sure") * (1 + 1e-12)))
        if once:
            told = kept(told)
            least = told.groupBy("_own").agg(F.min("_sure").alias("_least"))
            told = told.join(least, "_own").where(F.col("near") <= F.col("_least") * (1 + 1e-12)).drop("_least")
        told = kept(told.drop("_enough", "_sure").select(*mine, "path", "n", "leaf", "near", "far"))
        leaves = told.where("leaf")
        open_ = told.where(~F.col("leaf")).select(*mine, F.col("path").alias("parent"))
    pairs = unbroadcast(leaves, rows).join(points.select("_by", "path", "id", F.col("_label"), *AXES), ["_by", "path"])
    pairs = pairs.where(F.col("_label") != F.col("_own") if unlike else F.col("id") != F.col("source"))
    squared = sum((F.col(c) - F.col(f"s{c}")) * (F.col(c) - F.col(f"s{c}")) for c in AXES)
    pairs = pairs.select("source", F.col("id").alias("target"), F.sqrt(squared).alias("distance"))
    best = Window.partitionBy("source").orderBy("distance", "target")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
