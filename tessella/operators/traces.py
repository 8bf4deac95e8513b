"""Trace lines: the unbranched runs of a parent-pointer forest (id, parent, x, y, z, r), their measures, filters and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.operators.graph import forest_depths, hops_up, segments

AXES = ("x", "y", "z")


def _children(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent >= 0").groupBy("parent").agg(F.count(F.lit(1)).alias("_kids"))


def with_lines(nodes: DataFrame) -> DataFrame:
    """Nodes with their line, named by its first node, and their position in it. Lines begin at roots and at children of branch points."""
    told = nodes.select("id", "parent").join(_children(nodes), "parent", "left")
    cut = told.select("id", F.when(F.col("_kids") == 1, F.col("parent")).otherwise(F.lit(-1)).alias("parent"))
    place = forest_depths(cut).select("id", F.col("root").alias("line"), F.col("depth").alias("position"))
    return nodes.join(place, "id")


def line_table(nodes: DataFrame) -> DataFrame:
    """One row per line: size, length, end-to-end distance, tortuosity, density, distance to the parent line, whether it is a leaf, parent line and level.

    Density is nodes over length, 1 for a line of one node; tortuosity is length over end-to-end distance, null
    where that is 0.
    """
    placed = with_lines(nodes)
    kids = _children(nodes).withColumnRenamed("parent", "id")
    told = placed.join(segments(nodes).select("id", F.col("length").alias("_step")), "id").join(kids, "id", "left")
    ends = {f"_{c}": F.max_by(c, "position") - F.min_by(c, "position") for c in AXES}
    per = told.groupBy("line").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(F.when(F.col("position") > 0, F.col("_step")).otherwise(F.lit(0.0))).alias("length"),
        F.max(F.when(F.col("position") == 0, F.col("_step"))).alias("to_parent"),
        F.max(F.when(F.col("position") == 0, F.col("parent"))).alias("_parent"),
        F.max_by(F.coalesce("_kids", F.lit(0)) == 0, "position").alias("leaf"),
        *(v.alias(k) for k, v in ends.items()),
    )
    above = placed.select(F.col("id").alias("_parent"), F.col("line").alias("_above"))
    per = per.join(above, "_parent", "left").withColumn("parent_line", F.coalesce("_above", F.lit(-1)).cast("long"))
    level = forest_depths(per.select(F.col("line").alias("id"), F.col("parent_line").alias("parent"))).select(F.col("id").alias("line"), F.col("root").alias("tree"), F.col("depth").alias("level"))
    euclid = F.sqrt(sum(F.col(f"_{c}") * F.col(f"_{c}") for c in AXES))
    return per.withColumn("euclid", euclid).join(level, "line").select(
        "line",
        "tree",
        "parent_line",
        "level",
        "size",
        "length",
        "euclid",
        F.when(F.col("euclid") > 0, F.col("length") / F.col("euclid")).alias("tortuosity"),
        F.when((F.col("size") > 1) & (F.col("length") > 0), F.col("size") / F.col("length")).otherwise(F.lit(1.0)).alias("density"),
        "to_parent",
        "leaf",
    )


def short_lines(lines: DataFrame, size: int) -> DataFrame:
    """Lines of at most `size` nodes that bear no branches."""
    return lines.where((F.col("size") <= size) & F.col("leaf"))


def false_spines(lines: DataFrame, size: int, length: float) -> DataFrame:
    return lines.where((F.col("size") <= size) & (F.col("length") <= length) & F.col("leaf"))


def false_bridges(lines: DataFrame, size: int) -> DataFrame:
    return lines.where((F.col("size") <= size) & (F.col("density") <= 1) & ~F.col("leaf"))


def half_bridges(lines: DataFrame, size: int, least: float) -> DataFrame:
    return lines.where((F.col("size") <= size) & (F.col("to_parent") >= least))


def split_at(nodes: DataFrame, at: int) -> DataFrame:
    """The node becomes a root of its own."""
    return nodes.withColumn("parent", F.when(F.col("id") == at, F.lit(-1)).otherwise(F.col("parent")).cast(nodes.schema["parent"].dataType))


def exploded(nodes: DataFrame) -> DataFrame:
    """Every line becomes a tree."""
    kids = _children(nodes)
    told = nodes.join(kids, "parent", "left")
    return told.withColumn("parent", F.when(F.col("_kids") == 1, F.col("parent")).otherwise(F.lit(-1)).cast(nodes.schema["parent"].dataType)).select(*nodes.columns)


def without_lines(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Nodes without those of the chosen lines; what hung from them becomes trees."""
    kept = with_lines(nodes).join(lines.select("line"), "line", "left_anti").select(*nodes.columns)
    there = kept.select(F.col("id").alias("parent"), F.lit(True).alias("_there"))
    return kept.join(there, "parent", "left").withColumn("parent", F.when(F.col("_there"), F.col("parent")).otherwise(F.lit(-1)).cast(nodes.schema["parent"].dataType)).select(*nodes.columns)


def merged(nodes: DataFrame, root: int, into: int) -> DataFrame:
    """The tree of `root` hangs from the node `into` of another tree."""
    if not hops_up(nodes, into).where(F.col("id") == root).isEmpty():
        raise ValueError(f"{into} is a node of the tree of {root}")
    return nodes.withColumn("parent", F.when(F.col("id") == root, F.lit(into)).otherwise(F.col("parent")).cast(nodes.schema["parent"].dataType))


def with_soma(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """A new root amid the chosen ones, which become its children; its id is the next free one."""
    chosen = roots.select("id").distinct()
    free = nodes.agg((F.max("id") + 1).alias("_id"))
    soma = nodes.join(chosen, "id", "left_semi").agg(*(F.avg(c).alias(c) for c in AXES), F.max("r").alias("r")).crossJoin(free)  # one row each
    row = soma.select(*(F.col("_id").cast(f.dataType).alias("id") if f.name == "id" else F.lit(-1).cast(f.dataType).alias("parent") if f.name == "parent" else F.col(f.name) if f.name in (*AXES, "r") else F.lit(None).cast(f.dataType).alias(f.name) for f in nodes.schema.fields))
    told = nodes.join(chosen.withColumn("_chosen", F.lit(True)), "id", "left").crossJoin(F.broadcast(free))  # one row
    hung = told.withColumn("parent", F.when(F.col("_chosen"), F.col("_id")).otherwise(F.col("parent")).cast(nodes.schema["parent"].dataType)).select(*nodes.columns)
    return hung.unionByName(row)
