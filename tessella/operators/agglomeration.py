"""Agglomerative clustering of all points of a table: every merger from single points on, by the distances between points.

Single, average and complete linkage are reducible: two clusters that are each other's nearest stay so, whatever else merges. So a round
merges all such pairs at once, in any order of their distances, and the mergers of all rounds, sorted by distance, are those
that merging the closest pair each time makes. Where few pairs are mutual, a round takes the `most` clusters with the nearest neighbours
instead: no cluster outside has one nearer than these, so up to that distance nothing but they can merge, and one task does all of that from the
matrix of their distances. At the end at most `most` clusters are left, and the same task finishes.

Distances between clusters come from all pairs of their points, anew for clusters that merged or lost their nearest. Points lie in chunks
of bounded size, and a task compares two chunks; a cluster of more than `PART` points lies in several. All pairs of points meet, so work grows
with the square of the table; no more than two chunks, or the matrix of `most` clusters, is ever in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessella.sources.shared import dropped, settled

#: Points of a chunk, about; distances that a task holds at once; points from which a cluster is split over chunks.
CHUNK, CELLS, PART = 8192, 1 << 20, 1024
#: Clusters of a chunk, about, where all distances are returned.
SIDE = 1024
#: Tasks for pairs of chunks, at most.
TASKS = 2000
#: Clusters whose distances meet in one task.
MOST = 4096
#: A round merges mutually nearest pairs if one cluster in so many belongs to the first of a pair, at least.
FEW = 10
#: Ids of clusters: points have their rank, others the round above these bits; the bit below tells mergers of a window and of copies.
ROUND, WINDOW = 44, 1 << 43
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_JOIN = {"single": np.minimum, "average": np.add, "complete": np.maximum}
_CHUNKS = "grp int, c array<long>, n array<long>, k array<long>, rows array<int>, v binary, w binary"
_NEAR = "a long, b long, k long, d double, pairs double, whole boolean"
_STRIPS = "across boolean, a array<long>, b array<long>, d binary"
_DONE = "kind int, a long, b long, c long, n long, k long, r long, h double"


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """`df` with the number of each row in the given order, from 0; only the partitions' sizes reach the driver."""
    told = _kept(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    told = told.withColumns({"_p": F.shiftright("_m", 33), name: F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = sorted((r["_p"], r["count"]) for r in told.groupBy("_p").count().collect())  # one row a partition
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    starts = df.sparkSession.createDataFrame(starts, "_p long, _start long")
    return told.join(F.broadcast(starts), "_p").withColumn(name, F.col(name) + F.col("_start")).drop("_m", "_p", "_start")


def mergers(points: DataFrame, linkage: str = "average", most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(id, member), each point's rank by id, and the mergers (g, step, first, second, distance) of all points, closest first, g being 0.

    `points` has id and v. New clusters are numbered from the number of points on; the first of a merger is that with the smaller member. Points
    without a vector of finite numbers take no part. `most` bounds the clusters whose distances meet in one task, and changes no result
    but the order of equal distances.
    """
    v = F.transform("v", lambda x: x.cast("double") + 0.0)  # no negative zeros
    fit = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    base = numbered(points.select("id", v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & fit), "member", "id", "v")
    told = base.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    if told["low"] != told["high"]:
        raise ValueError(f"vectors of {told['low']} to {told['high']} numbers")
    n, unit = told["n"], 2.0 ** np.frexp(told["top"] or 1.0)[1]  # a power of two, so that squares neither overflow nor get lost
    found = _all_mergers(base.select("member", "v"), unit, linkage, most) if n > 1 else points.sparkSession.createDataFrame([], "a long, b long, c long, h double, round int, seq long")
    steps = made = _kept(numbered(found, "step", "h", "round", "seq"))
    for end in ("a", "b"):
        steps = steps.join(made.select(F.col("c").alias(end), (F.col("step") + n).alias(f"_{end}")), end, "left")
    names = (F.coalesce("_a", "a").alias("first"), F.coalesce("_b", "b").alias("second"))
    return base.select("id", "member"), steps.select(F.lit(0).alias("g"), F.col("step").cast("int").alias("step"), *names, (F.col("h") * float(unit)).alias("distance"))


def _kept(df: DataFrame, *done: DataFrame) -> DataFrame:
    return settled(df, "mergers", *done)


def _all_mergers(base: DataFrame, unit: float, linkage: str, most: int) -> DataFrame:
    """Clusters merged (a, b) and made (c), with height, round and order within the round."""
    points, made = _without_copies(base.select("member", F.transform("v", lambda x: x / unit).alias("v")))
    none = {"nn": F.lit(None).cast("long"), "d": F.lit(None).cast("double")}
    state = _kept(points.select("c", "n", "k", "r", F.lit(0.0).alias("h")).withColumns(none))
    points = _kept(points.select("c", "n", "k", "v", "w", F.lit(True).alias("ask")))
    rows = points.count()
    for number in range(1, 1 << (62 - ROUND)):
        m, asked = state.agg(F.count(F.lit(1)), F.sum(F.when(F.col("nn").isNull(), F.col("k")).otherwise(0))).first()
        if m <= most:
            if m > 1:
                made.append(_merged_in_window(points, state.collect(), rows, np.inf, linkage, number).where("kind = 0").select(*_round(number)))  # `most` rows at most
            return reduce(DataFrame.unionByName, made)
        if asked:
            state = _kept(_with_nearest(points, state, rows, asked, linkage), state)
        pairs = _kept(_mutual(state, number))
        moved, window = pairs.select(F.explode(F.array("a", "b")).alias("old"), "c", "n", "k"), None
        if pairs.count() * FEW < m:
            chosen = state.orderBy("d", "k", "r").limit(most).collect()  # as said, `most` rows
            inside = F.broadcast(base.sparkSession.createDataFrame([(r["c"],) for r in chosen], "c long"))
            window = _merged_in_window(points.join(inside, "c"), chosen, sum(r["k"] for r in chosen), max(r["d"] for r in chosen), linkage, number)
            for end in ("a", "b"):
                pairs = pairs.join(inside.withColumnRenamed("c", end), end, "left_anti")
            moved = pairs.select(F.explode(F.array("a", "b")).alias("old"), "c", "n", "k").unionByName(window.where("kind = 1").select(F.col("a").alias("old"), "c", "n", "k"))
        fresh = pairs.select("c", "n", "k", "r", "h")
        made.append(pairs.select(*_round(number)))
        if window is not None:
            fresh = fresh.unionByName(window.where("kind = 2").select(*fresh.columns))
            made.append(window.where("kind = 0").select(*_round(number)))
        if len(made) >= 32:
            made = [_kept(reduce(DataFrame.unionByName, made))]
        left = state.join(moved.select(F.col("old").alias("c")), "c", "left_anti").join(moved.select(F.col("old").alias("nn"), F.lit(True).alias("_gone")), "nn", "left")
        left = left.withColumns({x: F.when(F.col("_gone").isNull(), F.col(x)) for x in none}).drop("_gone")
        state = _kept(left.unionByName(fresh.withColumns(none)), state)
        # Whose clusters have changed or are asked again.
        again = state.where("nn is null").select(F.col("c").alias("old"), "c", "n", "k")
        change = moved.unionByName(again).select("old", *(F.col(x).alias(f"_{x}") for x in "cnk"))
        told = points.join(change, F.col("c") == F.col("old"), "left")
        points = _kept(told.select(*(F.coalesce(f"_{x}", x).alias(x) for x in "cnk"), "v", "w", F.col("old").isNotNull().alias("ask")), points)
    raise ValueError("too many rounds")


def _round(number: int) -> tuple[Column, ...]:
    return (F.col("a"), F.col("b"), F.col("c"), F.col("h"), F.lit(number).alias("round"), F.col("c").bitwiseAND(F.lit((1 << ROUND) - 1)).alias("seq"))


def _without_copies(base: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Clusters of equal points (c, n, k = 1, r, v, w), and their mergers at distance 0: a copy joins those of smaller rank.

    Copies follow each other in a sorted table, so each finds the one before by its number, however many there are.
    """
    equal = _kept(base.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("r")))
    columns = ("n", F.lit(1).cast("long").alias("k"), "r", "v", F.col("n").alias("w"))
    copied = equal.where("n > 1")
    if copied.isEmpty():
        return equal.select(F.col("r").alias("c"), *columns), []
    rows = _kept(numbered(base.join(copied.select("v"), "v", "left_semi"), "seq", "v", "member"))
    before = rows.select((F.col("seq") + 1).alias("seq"), F.col("v").alias("_v"), F.col("member").alias("_member"))
    told = _kept(rows.join(before, "seq", "left").select("seq", "member", "v", "_member", (F.col("_v") == F.col("v")).alias("copy")))
    first = told.select((F.col("seq") + 1).alias("seq"), F.col("copy").alias("_copy"))
    mark = lambda c: c.bitwiseOR(F.lit(WINDOW))
    made = told.where("copy").join(first, "seq").select(F.when(F.col("_copy"), mark(F.col("seq") - 1)).otherwise(F.col("_member")).alias("a"), F.col("member").alias("b"), mark(F.col("seq")).alias("c"), F.lit(0.0).alias("h"), F.lit(0).alias("round"), "seq")
    last = told.groupBy("v").agg(F.max("seq").alias("_last"))
    return equal.join(last, "v", "left").select(F.coalesce(mark(F.col("_last")), "r").alias("c"), *columns), [_kept(made)]


def _mutual(state: DataFrame, number: int) -> DataFrame:
    """Pairs (a, b) of clusters that are each other's nearest, and the cluster c that each makes."""
    other = state.select(*(F.col(x).alias(f"_{x}") for x in state.columns))
    told = state.join(other, F.col("nn") == F.col("_c")).where("_nn = c and r < _r")
    height = F.greatest("d", "h", "_h")  # rounding makes no merger closer than those before
    return told.select(F.col("c").alias("a"), F.col("_c").alias("b"), (F.col("r") + (number << ROUND)).alias("c"), *((F.col(x) + F.col(f"_{x}")).alias(x) for x in "nk"), "r", height.alias("h"))


def _chunks(points: DataFrame, rows: int, clusters: int = 0) -> tuple[DataFrame, int]:
    """The points in chunks, one row each, clusters together as far as `PART` allows; and how many chunks there may be.

    With the number of `clusters`, no chunk has more than some `SIDE` of them, since the distances between those of two chunks are returned.
    """
    many = max(-(-rows // CHUNK), -(-clusters // SIDE), 1)
    part = F.when(F.col("k") > PART, F.pmod(F.xxhash64("v"), F.ceil(F.col("k") / PART))).otherwise(F.lit(0).cast("long"))
    told = points.withColumns({"x": F.xxhash64("c"), "grp": F.pmod(F.xxhash64("c", part), F.lit(many)).cast("int")})
    return _kept(told.select("grp", "c", "n", "k", "x", "v", "w").groupBy("grp").applyInArrow(_packed, _CHUNKS)), many


def _packed(table: pa.Table) -> pa.Table:
    c, n, k, x, w = (table[name].to_numpy() for name in ("c", "n", "k", "x", "w"))
    _, of, here = np.unique(c, return_inverse=True, return_counts=True)
    order = np.lexsort((c, x, k, here[of] < k))
    v = table["v"].combine_chunks().flatten().to_numpy().reshape(len(c), -1)[order]
    starts = np.flatnonzero(np.diff(c[order], prepend=-1))
    rows, one = np.diff(starts, append=len(c)), order[starts]
    told = [table["grp"][0].as_py(), c[one].tolist(), n[one].tolist(), k[one].tolist(), rows.tolist(), v.tobytes(), w[order].tobytes() if (w > 1).any() else None]
    return pa.table({f.name: pa.array([x], f.type) for f, x in zip(_arrow(_CHUNKS), told, strict=True)})


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


class _Chunk:
    """Points by cluster: ids c, sizes n, rows in all chunks k and in this one; clusters that are whole in it come first."""

    def __init__(self, table: pa.Table) -> None:
        self.grp = table["grp"][0].as_py()
        self.c, self.n, self.k, self.rows = (table[x].combine_chunks().flatten().to_numpy() for x in ("c", "n", "k", "rows"))
        self.v = np.frombuffer(table["v"][0].as_buffer()).reshape(int(self.rows.sum()), -1)
        w = table["w"][0]
        self.w = np.frombuffer(w.as_buffer(), np.int64).astype(float) if w.is_valid else None
        self.ends = np.concatenate([[0], np.cumsum(self.rows)])
        self.whole = int((self.k == self.rows).sum())


def _joined(x: np.ndarray, rows: np.ndarray, join: np.ufunc) -> np.ndarray:
    """`join` over each cluster's rows of x; clusters of equal size that follow each other at once."""
    if len(rows) == len(x):
        return x
    out, at = np.empty((len(rows), x.shape[1])), 0
    for run in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows)) + 1):
        size = int(rows[run[0]])
        part = x[at : at + size * len(run)]
        out[run[0] : run[-1] + 1] = part if size == 1 else join.reduce(part.reshape(len(run), size, -1), axis=1)
        at += size * len(run)
    return out


def _strips(left: _Chunk, right: _Chunk, linkage: str) -> Iterator[tuple[slice, np.ndarray]]:
    """Sums (least, largest) of the distances between points of some clusters of the left and all of the right, some at a time."""
    middle = (left.v.sum(0) + right.v.sum(0)) / (len(left.v) + len(right.v))
    a, b = left.v - middle, right.v - middle
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    near, far = np.column_stack([-2 * a, aa, np.ones(len(a))]), np.column_stack([b, np.ones(len(b)), bb]).T.copy()
    most = max(CELLS // len(b), 1)
    room = np.empty(max(most, int(left.rows.max())) * len(b))
    lo = 0
    while lo < len(left.c):
        hi = max(int(np.searchsorted(left.ends, left.ends[lo] + most, "right")) - 1, lo + 1)
        some = slice(left.ends[lo], left.ends[hi])
        rows = some.stop - some.start
        d = np.matmul(near[some], far, out=room[: rows * len(b)].reshape(rows, -1))
        # Small differences of large numbers are computed again.
        small = 1e-5 * (aa[some] + bb.max())
        for p in np.flatnonzero(d.min(1) < small):
            q = np.flatnonzero(d[p] < small[p])
            gap = right.v[q] - left.v[some.start + p]
            d[p, q] = np.einsum("ij,ij->i", gap, gap)
        np.sqrt(d, out=d)
        if linkage == "average":
            for w in (right.w, left.w[some, None] if left.w is not None else None):
                if w is not None:
                    d *= w
        d = _joined(d, left.rows[lo:hi], _JOIN[linkage])
        if len(right.rows) < len(b):
            d = np.ascontiguousarray(_joined(np.ascontiguousarray(d.T), right.rows, _JOIN[linkage]).T)
        yield slice(lo, hi), d
        lo = hi


def _cells(left: DataFrame, right: DataFrame, many: tuple[int, int], half: bool, told: Callable[[_Chunk, _Chunk], pa.Table], schema: str) -> DataFrame:
    """`told` of each pair of chunks; with `half` the two tables are one, and each pair comes once."""
    to = F.sequence(F.col("grp") if half else F.lit(0), F.lit(many[1] - 1))
    back = F.sequence(F.lit(0), F.col("grp") if half else F.lit(many[0] - 1))
    a = left.withColumn("j", F.explode(to)).withColumn("i", F.col("grp"))
    b = right.withColumn("i", F.explode(back)).withColumn("j", F.col("grp"))

    def compared(x: pa.Table, y: pa.Table) -> pa.Table:
        return told(_Chunk(x), _Chunk(y)) if len(x) and len(y) else _arrow(schema).empty_table()

    # Each pair is much work, whatever its bytes.
    parts = min(many[0] * (many[0] + 1) // 2 if half else many[0] * many[1], TASKS)
    a, b = (side.repartition(parts, "i", "j") for side in (a, b))
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(compared, schema)


def _with_nearest(points: DataFrame, state: DataFrame, rows: int, asked: int, linkage: str) -> DataFrame:
    """`state` with the nearest cluster of those that have none yet, ties to that of fewest points and then by hash."""
    half = 2 * asked > rows
    right, many = _chunks(points, rows)
    left, some = (right, many) if half else _chunks(points.where("ask"), asked)

    def nearest(x: _Chunk, y: _Chunk) -> pa.Table:
        return _nearest(x, y, linkage, half and x.grp != y.grp)

    found = _kept(_cells(left, right, (some, many), half, nearest, _NEAR), left, right)
    join = {"single": F.min("d"), "average": F.sum("d") / F.max("pairs"), "complete": F.max("d")}[linkage]
    parts = found.where("not whole").groupBy("a", "b").agg(F.max("k").alias("k"), join.alias("d"))
    told = found.where("whole").select("a", "b", "k", "d").unionByName(parts)
    best = told.groupBy("a").agg(F.min(F.struct("d", "k", F.xxhash64("b").alias("x"), "b")).alias("_best")).select(F.col("a").alias("c"), F.col("_best.b").alias("_nn"), F.col("_best.d").alias("_d"))
    fresh = state.join(best, "c", "left")
    return fresh.select("c", "n", "k", "r", "h", F.coalesce("nn", "_nn").alias("nn"), F.coalesce("d", "_d").alias("d"))


def _nearest(x: _Chunk, y: _Chunk, linkage: str, both: bool) -> pa.Table:
    """Of whole clusters the nearest whole one of the other chunk, to which all distances of split ones are added; with `both` also the other way."""
    out: list[tuple] = []
    best, by = np.full(y.whole, np.inf), np.zeros(y.whole, int)
    order = np.argsort(y.c)
    for some, d in _strips(x, y, linkage):
        c, n = x.c[some], x.n[some].astype(float)
        # No cluster is its own neighbour.
        at = np.minimum(np.searchsorted(y.c, c, sorter=order), len(order) - 1)
        own = np.flatnonzero(y.c[order[at]] == c)
        d[own, order[at[own]]] = np.inf
        whole = max(min(x.whole - some.start, len(c)), 0)
        # Distances of clusters that lie in several chunks are told one by one.
        for i, j in ((slice(whole, None), slice(None)), (slice(whole), slice(y.whole, None))):
            i, j = (z.ravel() for z in np.meshgrid(np.arange(len(c))[i], np.arange(len(y.c))[j], indexing="ij"))
            i, j = i[keep := d[i, j] < np.inf], j[keep]
            out.append((c[i], y.c[j], y.k[j], d[i, j], n[i] * y.n[j], False))
            if both:
                out.append((y.c[j], c[i], x.k[some][i], d[i, j], n[i] * y.n[j], False))
        if whole and y.whole:
            mean = d[:whole, : y.whole]
            if linkage == "average" and (n.max() > 1 or y.n.max() > 1):
                mean /= n[:whole, None]
                mean /= y.n[: y.whole]
            nearest = mean.argmin(1)
            out.append((c[:whole], y.c[nearest], y.k[nearest], mean[np.arange(whole), nearest], np.ones(whole), True))
            if both:
                least = mean.min(0)
                nearer = np.flatnonzero(least < best)
                best[nearer] = least[nearer]
                by[nearer] = (mean[:, nearer] == least[nearer]).argmax(0) + some.start
    if both:
        out.append((y.c[: y.whole], x.c[by], x.k[by], best, np.ones(y.whole), True))
    columns = [np.concatenate([np.asarray(o[k]) for o in out]) for k in range(5)] + [np.concatenate([np.full(len(o[0]), o[5]) for o in out])]
    table = pa.table(dict(zip(_arrow(_NEAR).names, columns, strict=True)), schema=_arrow(_NEAR))
    return table.filter(pa.array(columns[3] < np.inf))


def _merged_in_window(points: DataFrame, clusters: list, rows: int, limit: float, linkage: str, number: int) -> DataFrame:
    """Mergers (kind 0) of the given clusters up to the limit, at least one, what becomes of each that merges (kind 1), and the clusters made (kind 2)."""
    chunks, many = _chunks(points, rows, len(clusters))

    def strips(x: _Chunk, y: _Chunk) -> pa.Table:
        told = [(x.grp != y.grp, x.c[some], y.c, d.tobytes()) for some, d in _strips(x, y, linkage)]
        return pa.table({f.name: pa.array([t[k] for t in told], f.type) for k, f in enumerate(_arrow(_STRIPS))})

    c, n, k, r, h = (np.array([row[x] for row in sorted(clusters, key=lambda row: row["r"])]) for x in ("c", "n", "k", "r", "h"))
    join, new = _JOIN[linkage], (number << ROUND) | WINDOW

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, order = np.sort(c), np.argsort(c)
        d = np.full((len(c), len(c)), {"single": np.inf, "average": 0.0, "complete": -np.inf}[linkage])
        seen = False
        for batch in batches:
            for t in range(batch.num_rows):
                seen = True
                i, j = (order[np.searchsorted(place, batch.column(x)[t].values.to_numpy())] for x in ("a", "b"))
                part = np.frombuffer(batch.column("d")[t].as_buffer()).reshape(len(i), len(j))
                d[np.ix_(i, j)] = join(d[np.ix_(i, j)], part)
                if batch.column("across")[t].as_py():
                    d[np.ix_(j, i)] = join(d[np.ix_(j, i)], part.T)
        if not seen:  # a partition without rows
            return
        if linkage == "average":
            d /= n.astype(float)[:, None]
            d /= n.astype(float)
        told = _sequence(d, n, k, r, h, limit, linkage)
        names, out = c.copy(), []
        size, rows, height, made = n.copy(), k.copy(), h.astype(float), {}
        up = np.arange(len(c))
        for seq, (i, j, distance) in enumerate(told):
            size[i], rows[i], height[i] = size[i] + size[j], rows[i] + rows[j], max(distance, height[i], height[j])
            out.append((0, names[i], names[j], new + seq, size[i], rows[i], r[i], height[i]))
            names[i], up[j] = new + seq, i
            made[i] = True
            made.pop(j, None)
        for i in made:
            out.append((2, -1, -1, names[i], size[i], rows[i], r[i], height[i]))
        touched = {x for i, j, _ in told for x in (i, j)}
        for i in sorted(touched):
            top = i
            while up[top] != top:
                up[top] = up[up[top]]
                top = up[top]
            out.append((1, c[i], -1, names[top], size[top], rows[top], r[top], height[top]))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(_arrow(_DONE))], schema=_arrow(_DONE))

    cells = _cells(chunks, chunks, (many, many), True, strips, _STRIPS)
    conf = points.sparkSession.conf
    now = conf.get(_BATCH)
    conf.set(_BATCH, "1")  # strips are large
    try:
        return _kept(cells.repartition(1).mapInArrow(merged, _DONE), chunks)
    finally:
        conf.set(_BATCH, now)


def _sequence(d: np.ndarray, n: np.ndarray, k: np.ndarray, r: np.ndarray, h: np.ndarray, limit: float, linkage: str) -> list[tuple[int, int, float]]:
    """Mergers of rows of the matrix `d`, closest first, up to the limit and at least one; a cluster stays in its smaller row."""
    np.fill_diagonal(d, np.inf)
    size, out = n.astype(float), []
    nearest = d.argmin(1)
    least = d[np.arange(len(d)), nearest]
    old = np.zeros(len(d), bool)  # whose nearest has merged: `least` is then a bound from below
    while len(out) < len(d) - 1:
        i = int(least.argmin())
        if old[i]:
            nearest[i], old[i] = d[i].argmin(), False
            least[i] = d[i, nearest[i]]
            continue
        if out and least[i] > limit:
            break
        distance, (i, j) = float(least[i]), sorted((i, int(nearest[i])))
        out.append((i, j, distance))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j]) if linkage == "average" else _JOIN[linkage](d[i], d[j])
        row[i] = row[j] = np.inf
        size[i] += size[j]
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
        least[j], old[j] = np.inf, False
        old |= (nearest == i) | (nearest == j)
        nearest[i], nearest[j], old[i], old[j] = row.argmin(), j, False, False
        least[i] = row[nearest[i]]
    return out
