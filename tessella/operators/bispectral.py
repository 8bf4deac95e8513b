"""Biclusters by a two-sided spectrum: leading singular vectors of a normalised matrix that is a table of its entries.

Rows and columns get an embedding each, by turns: one side's is the sum of the other's over the entries, a join and an aggregation, and a
Gram matrix of as many numbers as there are vectors squared keeps them apart. Rows and columns that lie close in both embeddings form
a bicluster. Entries that are 0 need no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tessella.operators import learning
from tessella.operators.graph import kept
from tessella.sources.shared import dropped


def normalised(entries: DataFrame) -> DataFrame:
    """Entries (r, c, w) divided by the roots of the sums of their row and column; sums must be positive, rows and columns of sum 0 go."""
    rows = entries.groupBy("r").agg(F.sum("w").alias("_r")).where("_r > 0")
    columns = entries.groupBy("c").agg(F.sum("w").alias("_c")).where("_c > 0")
    return entries.join(rows, "r").join(columns, "c").select("r", "c", (F.col("w") / F.sqrt(F.col("_r") * F.col("_c"))).alias("w"))


def _turned(v: str, matrix: np.ndarray) -> Column:
    """The array times a small matrix."""
    return F.array(*(sum((F.col(v)[i] * float(matrix[i, j]) for i in range(matrix.shape[0])), F.lit(0.0)) for j in range(matrix.shape[1])))


def _gram(side: DataFrame, n: int) -> np.ndarray:
    row = side.agg(*(F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n))).first()
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
    return out


def _times(entries: DataFrame, side: DataFrame, here: str, there: str, n: int) -> DataFrame:
    """Sums over the entries of the other side's vectors, one for each key of `here`."""
    met = entries.join(side, there)
    return met.groupBy(here).agg(F.array(*(F.sum(F.col("w") * F.col("v")[k]) for k in range(n))).alias("v"))


def singular_vectors(entries: DataFrame, n: int, rounds: int = 60, tolerance: float = 1e-6, more: int = 8) -> tuple[list[float], DataFrame, DataFrame]:
    """The n largest singular values of a matrix of entries (r, c, w), with (r, v) and (c, v): arrays of the left and right vectors.

    Subspace iteration from vectors drawn by hash, with `more` than asked for as far as there are columns, until no value moves by more than the
    tolerance. The driver holds square matrices of n + `more`. Signs are such that the column of the smallest key, where not 0, is positive; a matrix of lower rank has values near 0.
    """
    entries = kept(entries.select("r", "c", F.col("w").cast("double").alias("w")))
    columns = entries.select("c").distinct()
    wide = max(1, min(n + more, columns.count()))
    n = min(n, wide)
    drawn = F.array(*(F.xxhash64("c", F.lit(k)) / F.lit(2.0**63) for k in range(wide)))
    right = kept(columns.select("c", drawn.alias("v")))
    values = np.zeros(wide)
    for _ in range(rounds):
        left = kept(_times(entries, right, "r", "c", wide))
        scale, turn = np.linalg.eigh(_gram(left, wide))
        basis = turn / np.sqrt(np.maximum(scale, max(scale.max(), 1e-300) * 1e-14))
        before, right = right, kept(_times(entries, left.select("r", _turned("v", basis).alias("v")), "c", "r", wide))
        dropped(before, left)
        scale, turn = np.linalg.eigh(_gram(right, wide))
        order = np.argsort(-scale)
        scale, turn = np.sqrt(np.maximum(scale[order], 0)), turn[:, order]
        before, right = right, kept(right.select("c", _turned("v", turn / np.maximum(scale, max(scale[0], 1e-300) * 1e-7)).alias("v")))
        dropped(before)
        still, values = np.abs(scale[:n] - values[:n]).max() <= tolerance * max(scale[0], 1e-300), scale
        if still:
            break
    first = right.orderBy("c").limit(1).collect()
    sign = [1.0 if not first or first[0]["v"][k] >= 0 else -1.0 for k in range(n)]
    right = kept(right.select("c", F.array(*(F.col("v")[k] * sign[k] for k in range(n))).alias("v")))
    shrink = [1.0 / s if s > values[0] * 1e-7 else 0.0 for s in values[:n]]
    left = _times(entries, right, "r", "c", n)
    return values[:n].tolist(), left.select("r", F.array(*(F.col("v")[k] * shrink[k] for k in range(n))).alias("v")), right


def biclusters(entries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(r, cluster) and (c, cluster): rows and columns of a matrix without negative entries in k biclusters.

    The first singular vector tells only the sums; the next ones, over the roots of the sums, place rows and columns in one space, where
    they are clustered together.
    """
    vectors = max(1, int(np.ceil(np.log2(k)))) + 1
    _, left, right = singular_vectors(normalised(entries), vectors)
    sums = {"r": entries.groupBy("r").agg(F.sum("w").alias("s")), "c": entries.groupBy("c").agg(F.sum("w").alias("s"))}
    placed = [side.join(sums[key], key).select(F.struct(F.lit(key).alias("side"), F.col(key).cast("string").alias("key")).alias("id"), F.col(key).alias(key), F.transform(F.slice("v", 2, vectors - 1), lambda x: x / F.sqrt("s")).alias("v")) for key, side in (("r", left), ("c", right))]
    both = kept(placed[0].select("id", "v").unionByName(placed[1].select("id", "v")))
    found = kept(learning.kmeans(both, k))
    return tuple(p.select("id", key).join(found, "id").select(key, "cluster") for p, key in zip(placed, ("r", "c"), strict=True))
