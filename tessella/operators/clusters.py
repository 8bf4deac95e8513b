"""Selections and clusters as tables of ids: set algebra, edits, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in exactly one; one shuffle by counting sides instead of two differences."""
    key = a.columns[0]
    sides = a.distinct().withColumn("_s", F.lit(1)).union(b.distinct().withColumn("_s", F.lit(2)))
    return sides.groupBy(key).agg(F.sum("_s").alias("_s")).where("_s < 3").select(key)


OPERATORS = {"ADD": add, "SUBTRACT": subtract, "AND": both, "XOR": either}


def members(clusters: DataFrame, cluster: int) -> DataFrame:
    return clusters.where(F.col("cluster_id") == cluster).select("object_id")


def operate(clusters: DataFrame, first: int, second: int, operator: str, into: int) -> DataFrame:
    """The cluster table with cluster `into` overwritten by the operator's result."""
    made = OPERATORS[operator](members(clusters, first), members(clusters, second))
    kept = clusters.where(F.col("cluster_id") != into)
    return kept.unionByName(made.select(F.lit(into).cast(clusters.schema["cluster_id"].dataType).alias("cluster_id"), "object_id"))


def all_selected(clusters: DataFrame) -> DataFrame:
    return clusters.select("object_id").distinct()


def add_cluster(clusters: DataFrame, ids: DataFrame) -> DataFrame:
    """A new cluster under the next id."""
    number = clusters.agg((F.coalesce(F.max("cluster_id"), F.lit(0)) + 1).cast(clusters.schema["cluster_id"].dataType).alias("cluster_id"))
    return clusters.unionByName(ids.distinct().crossJoin(F.broadcast(number)).select("cluster_id", "object_id"))  # one row


def remove_cluster(clusters: DataFrame, cluster: int) -> DataFrame:
    return clusters.where(F.col("cluster_id") != cluster)


def remove_from_cluster(clusters: DataFrame, cluster: int, ids: DataFrame) -> DataFrame:
    gone = ids.select("object_id").distinct().withColumn("cluster_id", F.lit(cluster).cast(clusters.schema["cluster_id"].dataType))
    return clusters.join(gone, ["cluster_id", "object_id"], "left_anti")


def sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("objects"))


def append_with_offset(first: DataFrame, second: DataFrame, key: str, shift: dict[str, float] | None = None) -> DataFrame:
    """UNION ALL by position; the second table's ids move up by max(id) + 1 of the first, coordinates by `shift`."""
    if len(first.columns) != len(second.columns):
        raise ValueError("tables differ in their number of columns")
    offset = first.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).alias("_offset"))
    moved = second.toDF(*first.columns).crossJoin(F.broadcast(offset))  # one row
    columns = {key: (F.col(key) + F.col("_offset")).cast(first.schema[key].dataType)} | {c: F.col(c) + F.lit(d) for c, d in (shift or {}).items()}
    return first.union(moved.withColumns(columns).select(*first.columns))


def stacked(frames: dict[int, DataFrame], time: str = "time") -> DataFrame:
    """All frames below each other, with their time."""
    out = None
    for t, df in frames.items():
        told = df.withColumn(time, F.lit(t))
        out = told if out is None else out.unionByName(told, allowMissingColumns=True)
    if out is None:
        raise ValueError("no frames")
    return out
