"""Approximate nearest neighbours by multi-index hashing (operator 10).

Vectors get binary codes: signs after learned orthogonal rotations (iterative quantisation on a bounded sample of
`sample_rows` vectors, which also sets the Hamming radius r at which `recall` of its neighbours lie). A code is split
into m substrings of 16 bits, each with an index of its own. With r = m q + a, a code within r of a query has one of
its first a + 1 substrings within q of the query's, or one of the others within q - 1. So probing every index at those
distances retrieves all codes within r; these are reranked by the inner product of the original vectors.

Every row is indexed. Rows lie in blocks, each with its m indexes; queries, in groups, visit every block, and each
block returns its best k per query, for a final merge. Blocks and groups are bounded, and only one of the two is copied
as long as the other fits one block. In a block with fewer than k codes within r the radius grows until k are found, so
a query gets k results whenever there are k candidates. Vectors of unequal norms get one more component that makes the
norms equal, so that nearest by angle is nearest by inner product.

Vectors that are null, zero, or hold nulls or non-finite numbers take no part, nor does a null vec_id. A vector has an
inner product only with vectors of its length: each length is a search of its own. Every row is a candidate of its own;
rows with equal vec_id each answer as a query, with the others of that id among their candidates. Ties go to the smaller
vec_id; an inner product that is no number, because its terms overflow, ranks last. Very long vectors count by their length only in memory: a block holds 65,536 of them at most. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessella.llm.stage import written

BITS = 16
LEAST_BLOCK, MOST_BLOCK = 4096, 1 << 16
#: Rows of all tables of this size or less lie in so many blocks, for parallel work.
BLOCKS = 64
#: Queries that probe a block together.
QUERIES = 64
_WEIGHTS = np.bitwise_count(np.arange(1 << BITS, dtype=np.uint32)).astype(np.int64)
#: All masks of 16 bits in order of their number of ones, and how many have up to so many.
MASKS = np.argsort(_WEIGHTS, kind="stable").astype(np.uint16)
UP_TO = np.cumsum(np.bincount(_WEIGHTS))


@dataclass
class Coder:
    rotations: np.ndarray  # (dim + 1) x bits
    norm: float  # largest norm of all rows, in units of `scale`
    radius: int
    scale: float = 1.0  # largest component of all rows

    @property
    def substrings(self) -> int:
        return self.rotations.shape[1] // BITS

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """uint16 substrings of each vector's code."""
        x = x / self.scale
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        bits = np.column_stack([x, last]) @ self.rotations > 0
        return np.packbits(bits, axis=1).view(np.uint16)


def learn(sample: np.ndarray, norm: float, scale: float = 1.0, tables: int = 4, rounds: int = 20, k: int = 20, recall: float = 0.97, seed: int = 3) -> Coder:
    """Rotations that bring the sample closest to its signs, and the radius that finds `recall` of its neighbours."""
    rng = np.random.default_rng(seed)
    sample = sample / scale
    x = np.column_stack([sample, np.sqrt(np.maximum(norm**2 - (sample * sample).sum(1), 0))])
    dim = x.shape[1]
    made = []
    for _ in range(tables):
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.sign(x @ turn).T @ x)
            turn = (left @ right).T
        made.append(turn)
    rotations = np.hstack(made)
    bits = rotations.shape[1] // BITS * BITS
    coder = Coder(rotations[:, : max(bits, BITS)] if bits else np.hstack([rotations] * BITS)[:, :BITS], norm, 0)
    asked = sample[:256]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    if near.size:
        distance = hamming(coder.codes(asked, True), coder.codes(sample))
        coder.radius = int(np.quantile(np.take_along_axis(distance, near, 1), recall))
    coder.scale = scale
    return coder


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)), np.uint16)
    for j in range(a.shape[1]):
        total += np.bitwise_count(a[:, None, j] ^ b[None, :, j])
    return total


@dataclass
class Index:
    """One index of rows for each substring of their codes: the values that occur, their rows, and each row's value."""

    codes: np.ndarray  # rows x substrings
    used: list[np.ndarray]  # values in order
    member: list[np.ndarray]  # each row's place among them
    rows: list[np.ndarray]  # rows in order of their values
    begins: list[np.ndarray]  # where each of all 16-bit values begins there

    @classmethod
    def of(cls, codes: np.ndarray) -> Index:
        columns = [codes[:, j] for j in range(codes.shape[1])]
        used, member = zip(*(np.unique(c, return_inverse=True) for c in columns), strict=True)
        begins = [np.concatenate([[0], np.cumsum(np.bincount(c, minlength=1 << BITS))]) for c in columns]
        return cls(codes, list(used), list(member), [np.argsort(c, kind="stable") for c in columns], begins)

    def _probe(self, j: int, parts: np.ndarray, reach: int, found: np.ndarray) -> None:
        """Mark the rows in the buckets of one index within `reach` of each query's substring: by all masks, or by all buckets in use if these are fewer."""
        if UP_TO[reach] * 8 > len(self.used[j]):
            found |= (np.bitwise_count(parts[:, None] ^ self.used[j][None, :]) <= reach)[:, self.member[j]]
            return
        for q, part in enumerate(parts):
            buckets = (MASKS[: UP_TO[reach]] ^ part).astype(np.int64)
            first, last = self.begins[j][buckets], self.begins[j][buckets + 1]
            held = np.flatnonzero(last > first)
            count = (last - first)[held]
            ends = np.cumsum(count)
            if len(ends):
                found[q, self.rows[j][np.arange(ends[-1]) + np.repeat(first[held] - ends + count, count)]] = True

    def distances(self, asked: np.ndarray) -> np.ndarray:
        """Hamming distances of all rows' codes to those asked for, four substrings at a time where their number allows it."""
        wide = np.uint64 if self.codes.shape[1] % 4 == 0 else np.uint16
        a, b = np.ascontiguousarray(asked).view(wide), np.ascontiguousarray(self.codes).view(wide)
        total = np.zeros((len(a), len(b)), np.uint16)
        for w in range(a.shape[1]):
            total += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
        return total

    def within(self, asked: np.ndarray, radius: int) -> np.ndarray:
        """True for the rows whose codes lie within the radius of each one asked for, by probing the buckets that pigeonholes leave."""
        q, a = divmod(radius, asked.shape[1])
        found = np.zeros((len(asked), len(self.codes)), bool)
        for j in range(asked.shape[1]):
            reach = min(q if j <= a else q - 1, BITS)
            if reach >= 0:
                self._probe(j, asked[:, j], reach, found)
        if found.mean() > 0.1:
            return found & (self.distances(asked) <= radius)
        x, y = np.nonzero(found)
        found[x, y] = np.bitwise_count(self.codes[y] ^ asked[x]).sum(1, dtype=np.int64) <= radius
        return found


def search_block(coder: Coder, query_rows: np.ndarray, queries: np.ndarray, stored_rows: np.ndarray, ids: np.ndarray, stored: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of a block for each query, ties to the smaller id: places of queries, places of rows, and scores."""
    asked, index = coder.codes(queries, True), Index.of(coder.codes(stored))
    place = dict(zip(stored_rows.tolist(), range(len(stored_rows)), strict=True))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for q in range(len(query_rows)):
        if q % QUERIES == 0:
            found = index.within(asked[q : q + QUERIES], coder.radius)
        own = place.get(int(query_rows[q]), -1)
        near = np.flatnonzero(found[q % QUERIES])
        near = near[near != own]
        if len(near) < k:
            distance = index.distances(asked[q : q + 1])[0].astype(np.int64)
            if own >= 0:
                distance[own] = 1 << 20
            near = np.flatnonzero(distance <= np.sort(distance)[min(k, len(ids)) - 1])
            near = near[near != own]
        if not len(near):
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            score = stored[near] @ queries[q]
            if len(near) > k and np.isfinite(score).all():
                edge = np.partition(score, len(score) - k)[len(score) - k]
                near = near[score >= edge - 1e-9 * max(1.0, abs(edge))]
            exact = (stored[near] * queries[q]).sum(1)  # the same order of summation for equal vectors
        best = np.lexsort((ids[near], -np.where(np.isnan(exact), -np.inf, exact)))[:k]
        out.append((np.full(len(best), q), near[best], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v, its length dim, its largest component and the logarithm of its norm, of the vectors that take part; v is an array of double, or of float as it came."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # In units of the largest component, so that squares neither overflow nor vanish.
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") / F.col("top"), 2)))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad)
    sized = kept.withColumns({"dim": F.size("v"), "top": F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double"))))}).where(F.col("top") > 0)
    return sized.withColumn("norm", F.log("top") + F.log(norm))


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    return table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def search(vectors: DataFrame, every: int = 20, k: int = 20, sample_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row whose vec_id is divisible by `every`."""
    # Row numbers hold from here on: the table is written once.
    good = written(usable(vectors).withColumn("_row", F.monotonically_increasing_id()), "vectors")
    lengths = good.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), F.max("top").alias("top"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("asked"))
    found = vectors.sparkSession.createDataFrame([], "query_row long, query_id long, vec_id long, score double")
    for each in lengths.where("asked > 0").orderBy("dim").collect():  # one row a vector length
        found = found.unionByName(_search_length(good, each["dim"], each["n"], each["asked"], each["norm"], each["top"], every, k, sample_rows))
    best = Window.partitionBy("query_row").orderBy(F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score")).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search_length(table: DataFrame, dim: int, n: int, asked: int, norm: float, top: float, every: int, k: int, sample_rows: int) -> DataFrame:
    good = table.where(F.col("dim") == dim)
    drawn = good.orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id", "v").limit(sample_rows).select("v").collect()
    coder = learn(np.array([r["v"] for r in drawn], np.float64).reshape(-1, dim), math.exp(norm - math.log(top)), top, k=k)
    shared = good.sparkSession.sparkContext.broadcast(coder)

    block = min(MOST_BLOCK, max(LEAST_BLOCK, n // BLOCKS))
    n_blocks, n_groups = -(-n // block), -(-asked // MOST_BLOCK)
    part = lambda count, salt: F.pmod(F.xxhash64("_row", F.lit(salt)), F.lit(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    stored = good.select(part(n_blocks, 1).alias("b"), all_of(n_groups).alias("g"), "_row", "vec_id", "v")
    # Read anew: both sides of a cogroup need columns of their own.
    asking = good.sparkSession.read.schema(table.schema).parquet(table.written_to).where(F.col("dim") == dim)
    queries = asking.where(F.col("vec_id") % every == 0).select(all_of(n_blocks).alias("b"), part(n_groups, 2).alias("g"), "_row", "vec_id", "v")

    def run(rows: pa.Table, asking: pa.Table) -> pa.Table:
        ids, query_ids, query_rows = (t[c].to_numpy() for t, c in ((rows, "vec_id"), (asking, "vec_id"), (asking, "_row")))
        if len(ids) and len(query_ids):
            q, r, score = search_block(shared.value, query_rows, _matrix(asking, dim), rows["_row"].to_numpy(), ids, _matrix(rows, dim), k)
        else:
            q = r = np.zeros(0, np.int64)
            score = np.zeros(0)
        return pa.table({"query_row": query_rows[q], "query_id": query_ids[q], "vec_id": ids[r], "score": score})

    met = stored.groupBy("b", "g").cogroup(queries.groupBy("b", "g"))
    return met.applyInArrow(run, "query_row long, query_id long, vec_id long, score double")
