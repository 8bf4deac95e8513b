"""Exact Euclidean distance maps over voxel tables (t, ch, z, y, x, ..), and holes filled.

The squared distance separates by axes: one pass along x, then y, then z. In each, a line of voxels takes the lower envelope of the
parabolas that stand on its voxels, whose heights the pass before it left. Lines are dealt out by their place in the other axes, and a task solves
many at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from tessella.operators.graph import components, kept, unbroadcast

PLACE = ("t", "ch", "z", "y", "x")


def envelope(line: np.ndarray, at: np.ndarray, height: np.ndarray, weight: float) -> np.ndarray:
    """For voxels sorted by line and place: the least of height[j] + weight (at - at[j])**2 over the voxels j of the line; infinite without any finite one.

    The best j never moves back along a line. So the middle voxel of a stretch is solved first and halves the choices of both
    sides; all stretches of all lines go level by level, n log n steps in all.
    """
    out = np.full(len(at), np.inf)
    sites = np.flatnonzero(np.isfinite(height))
    if not len(sites):
        return out
    starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    ends = np.append(starts[1:], len(line))
    first, last = np.searchsorted(sites, starts), np.searchsorted(sites, ends) - 1
    some = first <= last
    low, high, first, last = starts[some], ends[some] - 1, first[some], last[some]
    where, tall = at[sites].astype(float), height[sites]
    while len(low):
        mid = (low + high) // 2
        many = last - first + 1
        begin = np.concatenate([[0], np.cumsum(many)])
        choice = np.arange(begin[-1]) + np.repeat(first - begin[:-1], many)
        cost = tall[choice] + weight * (np.repeat(at[mid], many) - where[choice]) ** 2
        least = np.minimum.reduceat(cost, begin[:-1])
        hit = np.flatnonzero(cost == np.repeat(least, many))
        best = choice[hit[np.searchsorted(hit, begin[:-1])]]
        out[mid] = least
        left, right = low < mid, mid < high
        low, high, first, last = (np.concatenate(x) for x in ((low[left], mid[right] + 1), (mid[left] - 1, high[right]), (first[left], best[right]), (best[left], last[right])))
    return out


def _filled(batch: pa.RecordBatch, change: np.ndarray, keys: list[int], at: int, d: int, low: int, high: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Lines with all places from low to high, those that were missing without a row and infinitely far, and where lines begin."""
    width, starts = high - low + 1, np.flatnonzero(change)
    if len(starts) * width == batch.num_rows:
        return batch, change
    place = (np.cumsum(change) - 1) * width + batch.column(at).to_numpy() - low
    source = np.full(len(starts) * width, -1, np.int64)
    source[place] = np.arange(batch.num_rows)
    missing = source < 0
    whole = batch.take(pa.array(source, mask=missing))
    for k in keys:
        whole = whole.set_column(k, whole.schema.field(k), pa.array(np.repeat(batch.column(k).to_numpy()[starts], width)))
    whole = whole.set_column(at, whole.schema.field(at), pa.array(np.tile(np.arange(low, high + 1), len(starts))))
    heights = np.full(len(source), np.inf)
    heights[place] = batch.column(d).to_numpy()
    first = np.zeros(len(source), bool)
    first[::width] = True
    return whole.set_column(d, whole.schema.field(d), pa.array(heights)), first


def _along(voxels: DataFrame, axis: str, weight: float, bounds: tuple[int, int] | None) -> DataFrame:
    """One pass: `d` of every voxel by the envelope of its line along the axis; of all places within the bounds, if given."""
    line = [c for c in PLACE if c != axis]
    names = voxels.columns
    keys, at, d = [names.index(c) for c in line], names.index(axis), names.index("d")

    def solved(table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks().to_batches()[0]
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.concatenate([[True], reduce(np.logical_or, (c[1:] != c[:-1] for c in columns))])
        if bounds is not None:
            batch, change = _filled(batch, change, keys, at, d, *bounds)
        value = envelope(np.cumsum(change), batch.column(at).to_numpy(), batch.column(d).to_numpy(), weight)
        return batch.set_column(d, "d", pa.array(value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            change = np.flatnonzero(reduce(np.logical_or, (c[1:] != c[:-1] for c in columns)))
            same = bool(held) and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys)
            # Whole lines go on; the last one may have more in the next batch.
            cut = int(change[-1]) + 1 if len(change) else 0
            if held and not (same and cut == 0):
                yield solved(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield solved(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield solved(pa.Table.from_batches(held))

    return voxels.repartition(*line).sortWithinPartitions(*line, axis).mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in voxels.schema.fields]))


def distance_map(voxels: DataFrame, sites: Column, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """The voxels with `distance2`, the squared distance to the nearest voxel of the same time and channel for which `sites` holds; null if there is none.

    `spacing` is that of z, y and x. There is one row a voxel; where some are missing, the passes along x and y fill the lines that there are
    up to the bounds of the table, since the next pass needs their heights. A task holds the lines that end in one batch, a line of any
    length whole.
    """
    integral = {c: voxels.schema[c].dataType for c in PLACE}
    flat = voxels.select(*(F.col(c).cast("long").alias(c) for c in PLACE), F.struct(*(c for c in voxels.columns)).alias("_row"), F.when(sites, F.lit(0.0)).otherwise(F.lit(float("inf"))).alias("d"))
    ends = voxels.agg(*(f(c).alias(f"{k}{c}") for c in "xy" for k, f in (("lo", F.min), ("hi", F.max)))).first()
    if ends["lox"] is None:
        return voxels.withColumn("distance2", F.lit(None).cast("double"))
    for axis, step in zip("xyz", spacing[::-1], strict=True):
        flat = _along(flat, axis, float(step) ** 2, (int(ends[f"lo{axis}"]), int(ends[f"hi{axis}"])) if axis in "xy" else None)
    flat = flat.where("_row is not null")
    told = F.when(F.col("d") < float("inf"), F.col("d"))
    return flat.select(*(F.col(f"_row.{c}").cast(integral.get(c, voxels.schema[c].dataType)).alias(c) for c in voxels.columns), told.alias("distance2"))


def _runs(voxels: DataFrame) -> DataFrame:
    """Voxels with `run`, one for each stretch without a gap along x, named by its line and first place."""
    line = Window.partitionBy("t", "ch", "z", "y").orderBy("x")
    apart = F.sum((F.col("x") != F.lag("x").over(line) + 1).cast("int")).over(line)
    first = Window.partitionBy("t", "ch", "z", "y", "_s")
    return voxels.withColumn("_s", F.coalesce(apart, F.lit(0))).withColumn("_f", F.min("x").over(first)).withColumn("run", F.struct("t", "ch", "z", "y", F.col("_f").alias("x"))).drop("_s", "_f")


def regions(voxels: DataFrame) -> DataFrame:
    """The voxels with `region`, the first voxel (t, ch, z, y, x) of their connected region over faces.

    Voxels that follow each other along x are one vertex; edges join those of neighbouring lines that touch.
    """
    told = kept(_runs(voxels))
    rows, edges = told.count(), None
    for axis in ("y", "z"):
        moved = told.select("t", "ch", *(F.col(c) + (1 if c == axis else 0) if c == axis else F.col(c) for c in ("z", "y", "x")), F.col("run").alias("target")).toDF("t", "ch", "z", "y", "x", "target")
        met = told.select(*PLACE, F.col("run").alias("source")).join(unbroadcast(moved, rows), list(PLACE)).select("source", "target").distinct()
        edges = met if edges is None else edges.unionByName(met)
    place = components(told.select(F.col("run").alias("id")).distinct(), kept(edges))
    return told.join(unbroadcast(place.select(F.col("id").alias("run"), F.col("component").alias("region")), rows), "run").drop("run")


def fill_holes(voxels: DataFrame) -> DataFrame:
    """Background (label 0) that reaches no border of its volume goes to an object that it touches: the one with most common faces, then the smallest label.

    The border is that of the box of all voxels of a time and channel; missing voxels count as border too.
    """
    empty = kept(regions(voxels.where("label = 0")))
    rows = empty.count()
    box = voxels.groupBy("t", "ch").agg(*(f(c).alias(f"{k}{c}") for c in ("z", "y", "x") for k, f in (("lo", F.min), ("hi", F.max))))
    moves = F.array(*(F.struct(*(F.lit(s if c == a else 0).alias(c) for c in ("z", "y", "x"))) for a in ("z", "y", "x") for s in (-1, 1)))
    asked = empty.select("t", "ch", "region", F.explode(moves).alias("m"), "z", "y", "x").select("t", "ch", "region", *((F.col(c) + F.col(f"m.{c}")).alias(c) for c in ("z", "y", "x")))
    near = unbroadcast(asked, rows).join(voxels.select(*PLACE, F.col("label").alias("near")), list(PLACE), "left").join(box, ["t", "ch"])
    out = reduce(lambda a, b: a | b, ((F.col(c) < F.col(f"lo{c}")) | (F.col(c) > F.col(f"hi{c}")) for c in ("z", "y", "x")))
    open_ = near.groupBy("region").agg(F.max((out | F.col("near").isNull()).cast("int")).alias("open")).where("open = 0").select("region")
    touched = near.where("near <> 0").groupBy("region", "near").agg(F.count(F.lit(1)).alias("faces")).join(unbroadcast(open_, rows), "region", "left_semi")
    most = touched.groupBy("region").agg(F.max(F.struct("faces", (-F.col("near")).alias("l"))).alias("m")).select("region", (-F.col("m.l")).alias("_fill"))
    filled = unbroadcast(empty, rows).join(unbroadcast(most, rows), "region").select(*PLACE, "_fill")
    return voxels.join(unbroadcast(filled, rows), list(PLACE), "left").withColumn("label", F.coalesce("_fill", "label").cast(voxels.schema["label"].dataType)).select(*voxels.columns)
