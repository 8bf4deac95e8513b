"""Rows to ask labels for, chosen together: each adds most to what the rows before it tell.

The information of a set is log det(I + sum of u x x'), x a row's features and u its uncertainty. A row's gain, log(1 + u x' A x) with A the inverse so
far, only falls as others are chosen. So the gains of one scan are bounds for later rounds: the `ahead` rows of largest bound compete until the best of
them falls behind the bound of all others, and only then all rows are scored anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.operators.graph import kept


def _gains(x: np.ndarray, u: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    return np.log1p(u * np.einsum("ij,jk,ik->i", x, inverse, x))


def _scored(rows: DataFrame, inverse: np.ndarray) -> DataFrame:
    dim = len(inverse)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            gain = _gains(x, batch.column(2).to_numpy(), inverse)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gain)], names=["id", "v", "u", "gain"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, u double, gain double")


def informative_batch(rows: DataFrame, k: int, ahead: int = 1000) -> DataFrame:
    """rank, id and gain of k rows of (id, v, u), greedily by information, ties to the smaller id.

    The driver holds `ahead` rows and a matrix of the features' dimension squared. Rows without features or uncertainty take no part.
    """
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    own = kept(rows.where("v is not null and u is not null and id is not null").select("id", F.col("v").cast("array<double>").alias("v"), F.col("u").cast("double").alias("u")))
    one = own.limit(1).collect()
    inverse = np.eye(len(one[0]["v"]) if one else 0)
    chosen: list[tuple[int, object, float]] = []
    while one and len(chosen) < k:
        left = own.join(spark.createDataFrame([(c[1],) for c in chosen], f"id {kind}"), "id", "left_anti") if chosen else own
        best = _scored(left.select("id", "v", "u"), inverse).orderBy(F.col("gain").desc(), "id").limit(ahead + 1).collect()
        if not best:
            break
        # What the rows that aren't here may gain at most, with its id; none is left if there are fewer.
        rest = (best[-1]["gain"], best[-1]["id"]) if len(best) > ahead else (-np.inf, None)
        near = best[:ahead]
        x, u = np.array([r["v"] for r in near]), np.array([r["u"] for r in near])
        open_ = np.ones(len(near), bool)
        while len(chosen) < k and open_.any():
            gain = np.where(open_, _gains(x, u, inverse), -np.inf)
            top = float(gain.max())
            at = min(np.flatnonzero(gain >= top - 1e-12 * max(1.0, abs(top))), key=lambda i: near[i]["id"])
            if chosen and not open_.all() and top <= rest[0]:
                break
            chosen.append((len(chosen) + 1, near[at]["id"], float(gain[at])))
            open_[at] = False
            side = inverse @ x[at]
            inverse = inverse - np.outer(side, side) * (u[at] / (1 + u[at] * float(x[at] @ side)))
    return spark.createDataFrame(chosen, f"rank int, id {kind}, gain double")
