"""The gap statistic: many clusterings of the data and of uniform references at once.

Reference b replaces every row by one drawn uniformly in the data's bounding box from a hash of its id, so references are never stored:
a task makes them from the rows that it reads. One round of Lloyd's algorithm for all references and numbers of clusters is one
scan, whose partial sums per (reference, k, cluster) meet in one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_GOLDEN, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def uniform(ids: np.ndarray, reference: int, dim: int, seed: int) -> np.ndarray:
    """Numbers in [0, 1), a row for each hashed id; the same on every run."""
    with np.errstate(over="ignore"):
        h = ids[:, None] + _GOLDEN * (np.arange(dim, dtype=np.uint64)[None, :] + np.uint64(1 + dim * (reference + 1000 * seed)))
        for shift in (30, 27, 31):
            h = (h ^ (h >> np.uint64(shift))) * _MIX
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _drawn(x: np.ndarray, ids: np.ndarray, b: int, low: np.ndarray, high: np.ndarray, seed: int) -> np.ndarray:
    """Rows of reference b; 0 is the data."""
    return x if b == 0 else low + (high - low) * uniform(ids, b, x.shape[1], seed)


def spread_out(x: np.ndarray, k: int) -> np.ndarray:
    """k rows, each the farthest from those before it, beginning with the one farthest from the mean."""
    far = ((x - x.mean(0)) ** 2).sum(1)
    chosen = [int(far.argmax())]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def gap_statistic(points: DataFrame, most: int = 10, references: int = 20, rounds: int = 50, sample: int = 1000, seed: int = 7) -> DataFrame:
    """k, log_w, expected, gap, s and chosen for each number of clusters up to `most`, of points (id, v).

    gap is the mean over the references of the logarithm of the squared distances to the nearest of k centres, less that of the data; s its deviation
    times sqrt(1 + 1 / references). Chosen is the smallest k with gap(k) >= gap(k + 1) - s(k + 1). Centres begin spread out in a
    sample of at most `sample` rows of each reference; all else covers all rows. The driver holds (references + 1) most**2 / 2 centres.
    Rows without a vector are left out; no row gives no k, and no more clusters are tried than the sample has rows.
    """
    own = points.where("v is not null").select(F.xxhash64("id").alias("h"), F.col("v").cast("array<double>").alias("v"))
    drawn = own.orderBy("h").limit(sample).collect()
    schema = "k int, log_w double, expected double, gap double, s double, chosen boolean"
    if not drawn:
        return points.sparkSession.createDataFrame([], schema)
    box = own.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("d").collect()  # one row a dimension
    low, high = (np.array([r[c] for r in box]) for c in ("low", "high"))
    dim, most = len(box), min(most, len(drawn))
    x, ids = np.array([r["v"] for r in drawn]), np.array([r["h"] for r in drawn], np.int64).view(np.uint64)
    centres = {}
    for b in range(references + 1):
        first = spread_out(_drawn(x, ids, b, low, high, seed), most)
        centres |= {(b, k): first[:k] for k in range(1, most + 1)}
    squares: dict[tuple[int, int], float] = {}
    open_ = set(centres)
    for _ in range(rounds):
        sums = _round(own, {key: centres[key] for key in open_}, low, high, seed, dim)
        found: dict[tuple[int, int], list] = {}
        for r in sums.collect():  # one row for each centre that is still moving
            found.setdefault((r["b"], r["k"]), []).append(r)
        for key, rows in found.items():
            fresh = centres[key].copy()
            for r in rows:
                fresh[r["c"]] = np.array(r["total"]) / r["n"]
            squares[key] = sum(r["squares"] for r in rows)
            if np.allclose(fresh, centres[key], rtol=0, atol=1e-9 * max(1.0, float(np.abs(high - low).max()))):
                open_.discard(key)
            centres[key] = fresh
        if not open_:
            break
    return points.sparkSession.createDataFrame(_judged(squares, most, references), schema)


def _judged(squares: dict[tuple[int, int], float], most: int, references: int) -> list[tuple]:
    logs = {key: float(np.log(max(w, 1e-300))) for key, w in squares.items()}
    gap, s, expected = {}, {}, {}
    for k in range(1, most + 1):
        of = np.array([logs[b, k] for b in range(1, references + 1)])
        expected[k], s[k] = float(of.mean()), float(of.std() * np.sqrt(1 + 1 / references))
        gap[k] = expected[k] - logs[0, k]
    chosen = next((k for k in range(1, most) if gap[k] >= gap[k + 1] - s[k + 1]), most)
    return [(k, logs[0, k], expected[k], gap[k], s[k], k == chosen) for k in range(1, most + 1)]


def _round(own: DataFrame, centres: dict[tuple[int, int], np.ndarray], low: np.ndarray, high: np.ndarray, seed: int, dim: int) -> DataFrame:
    """b, k, c, rows, sum and squared distances of the points nearest to each centre."""
    by_reference: dict[int, list[tuple[int, np.ndarray]]] = {}
    for (b, k), c in sorted(centres.items()):
        by_reference.setdefault(b, []).append((k, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = part.column(0).to_numpy().view(np.uint64)
                x = part.column(1).flatten().to_numpy().reshape(-1, dim)
                for b, clusterings in by_reference.items():
                    y = _drawn(x, ids, b, low, high, seed)
                    for k, c in clusterings:
                        far = ((y[:, None, :] - c[None, :, :]) ** 2).sum(2)
                        best = far.argmin(1)
                        for j in np.unique(best):
                            own_rows = best == j
                            told = held.setdefault((b, k, int(j)), [0, np.zeros(dim), 0.0])
                            told[0] += int(own_rows.sum())
                            told[1] += y[own_rows].sum(0)
                            told[2] += float(far[own_rows, j].sum())
        keys = list(held)
        columns = [pa.array([key[i] for key in keys], pa.int32()) for i in range(3)]
        columns += [pa.array([held[key][0] for key in keys], pa.int64()), pa.array([held[key][1].tolist() for key in keys], pa.list_(pa.float64())), pa.array([held[key][2] for key in keys], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["b", "k", "c", "n", "total", "squares"])

    parts = own.mapInArrow(run, "b int, k int, c int, n long, total array<double>, squares double")
    return parts.groupBy("b", "k", "c").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[d]) for d in range(dim))).alias("total"), F.sum("squares").alias("squares"))
