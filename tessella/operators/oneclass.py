"""A one-class margin over all rows: random Fourier features, and weights by conditional gradients.

The kernel exp(-gamma |x - y|**2) becomes an inner product of `size` cosines. The margin's dual asks for the shortest mean of the rows' features in which no
row weighs more than 1 / (nu n). A round scores all rows, finds by a histogram the share nu of lowest scores, takes the mean of their
features - two scans with small sums - and steps towards it as far as the length shrinks; the gap to the best is known in each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.operators.graph import kept

BINS = 2048


@dataclass
class Margin:
    mean: np.ndarray
    scale: np.ndarray
    turns: np.ndarray  # dim x size
    phase: np.ndarray
    weights: np.ndarray
    rho: float = 0.0

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / len(self.phase)) * np.cos((x - self.mean) / self.scale @ self.turns + self.phase)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _parts(batches: Iterator[pa.RecordBatch], dim: int, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            yield part, _matrix(part.column(at), dim)


def _histogram(own: DataFrame, model: Margin, low: float, high: float) -> np.ndarray:
    dim = len(model.mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for _, x in _parts(batches, dim, 0):
            total += np.bincount(_bins(model.features(x) @ model.weights, low, high), minlength=BINS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bin", "n"])

    out = np.zeros(BINS, np.int64)
    for r in own.mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most BINS rows
        out[r["bin"]] = r["n"]
    return out


def _bins(score: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(((score - low) / (high - low) * BINS).astype(np.int64), 0, BINS - 1)


def _lowest(own: DataFrame, model: Margin, low: float, high: float, edge: int, share: float, whole: float) -> np.ndarray:
    """Mean of the features of the rows in bins below `edge`, and of that bin's by their share, of `whole` rows in all."""
    dim, size = len(model.mean), len(model.phase)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, x in _parts(batches, dim, 0):
            f = model.features(x)
            bins = _bins(f @ model.weights, low, high)
            total += np.where(bins < edge, 1.0, np.where(bins == edge, share, 0.0)) @ f
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    row = own.mapInArrow(run, "v array<double>").agg(F.array(*(F.sum(F.col("v")[k]) for k in range(size)))).first()
    return np.array(row[0]) / whole


def fit(points: DataFrame, nu: float = 0.1, size: int = 256, gamma: float | None = None, rounds: int = 40, tolerance: float = 1e-3, seed: int = 5) -> Margin:
    """The margin of points (id, v) that leaves about the share nu outside; gamma is 1 / dimensions of scaled features if not given."""
    own = kept(points.where("v is not null").select(F.col("v").cast("array<double>").alias("v")))
    told = own.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).orderBy("d").collect()  # one row a dimension
    if not told:
        raise ValueError("no row has features")
    mean, scale = np.array([r["mean"] for r in told]), np.array([r["sd"] or 1.0 for r in told])
    rng = np.random.default_rng(seed)
    turns = rng.normal(size=(len(mean), size)) * np.sqrt(2 * (gamma or 1 / len(mean)))
    model = Margin(mean, scale, turns, rng.uniform(0, 2 * np.pi, size), np.zeros(size))
    n = own.count()
    # The mean of all rows is allowed, and a good beginning.
    model.weights = _lowest(own, model, -1.0, 1.0, BINS, 1.0, n)
    for _ in range(rounds):
        reach = float(np.linalg.norm(model.weights)) * np.sqrt(2) + 1e-12
        counts = np.cumsum(_histogram(own, model, -reach, reach))
        edge = int(np.searchsorted(counts, nu * n))
        below = counts[edge - 1] if edge else 0
        share = (nu * n - below) / (counts[edge] - below)
        model.rho = -reach + 2 * reach * (edge + share) / BINS
        aim = _lowest(own, model, -reach, reach, edge, share, nu * n)
        way = model.weights - aim
        gap = float(model.weights @ way)
        if gap <= tolerance * float(model.weights @ model.weights):
            break
        model.weights = model.weights - min(1.0, gap / float(way @ way)) * way
    reach = float(np.linalg.norm(model.weights)) * np.sqrt(2) + 1e-12
    counts = np.cumsum(_histogram(own, model, -reach, reach))
    edge = int(np.searchsorted(counts, nu * n))
    below = counts[edge - 1] if edge else 0
    model.rho = -reach + 2 * reach * (edge + (nu * n - below) / (counts[edge] - below)) / BINS
    return model


def score(points: DataFrame, model: Margin) -> DataFrame:
    """id, score and outlier of points (id, v): a negative score lies outside the margin. Rows without features have none."""
    own = points.where("v is not null").select("id", F.col("v").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _parts(batches, len(model.mean), 1):
            value = model.features(x) @ model.weights - model.rho
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value), pa.array((value < 0).astype(np.int32))], names=["id", "score", "outlier"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, score double, outlier int")
