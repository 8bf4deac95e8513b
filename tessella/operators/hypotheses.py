"""Merge hypotheses: all connected sets of regions up to a size and a volume, each made exactly once.

A set grows from its smallest region. It carries the regions that may still join it, in an order of its own; whichever joins,
those before it in that order may not join any more, and those are added that it alone brings within reach. So every
connected set has one way to be made, no set is ever compared with another, and a round is one join with the neighbour lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tessella.operators.graph import kept


def merge_hypotheses(regions: DataFrame, edges: DataFrame, most: int, max_volume: float) -> DataFrame:
    """members (ids in order), size and volume of every connected set of at most `most` regions whose volumes sum to at most `max_volume`.

    `regions` has id and volume, not negative; `edges` source and target. The number of sets grows with the neighbours of a region to the power of
    `most`, which is the bound to choose. A region's neighbours are one list. Regions without a volume are left out.
    """
    own = regions.where("volume is not null").select("id", F.col("volume").cast("double").alias("volume"))
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source <> target").distinct()
    near = both.join(own.select(F.col("id").alias("target")), "target", "left_semi").groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_list("target")).alias("near"))
    lists = kept(own.join(near, "id", "left").withColumn("near", F.coalesce("near", F.array().cast(f"array<{own.schema['id'].dataType.simpleString()}>"))))
    start = lists.where(F.col("volume") <= max_volume)
    larger = F.filter("near", lambda x: x > F.col("id"))
    made = [kept(start.select(F.col("id").alias("root"), F.array("id").alias("members"), "volume", larger.alias("open"), F.array_union(F.array("id"), F.col("near")).alias("seen")))]
    for _ in range(most - 1):
        grown = made[-1].select("root", "members", "volume", "open", "seen", F.posexplode("open").alias("at", "id"))
        told = grown.join(lists.select("id", F.col("volume").alias("_more"), "near"), "id").where(F.col("volume") + F.col("_more") <= max_volume)
        fresh = F.filter(F.array_except("near", "seen"), lambda x: x > F.col("root"))
        rest = F.expr("slice(open, at + 2, size(open))")
        sets = kept(told.select("root", F.array_append("members", F.col("id")).alias("members"), (F.col("volume") + F.col("_more")).alias("volume"), F.concat(rest, fresh).alias("open"), F.array_union("seen", "near").alias("seen")))
        if sets.isEmpty():
            break
        made.append(sets)
    whole = reduce(DataFrame.unionByName, made)
    return whole.select(F.array_sort("members").alias("members"), F.size("members").alias("size"), "volume")
