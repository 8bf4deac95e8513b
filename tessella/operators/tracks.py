"""Ordered measures over tracks: rows (track, t, x, y, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

AXES = ("x", "y", "z")


def _norm(*parts):
    return F.sqrt(sum(p * p for p in parts))


def steps(rows: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Displacement and speed of every point against the one before it; zeros for a track's first point."""
    order = Window.partitionBy("track").orderBy("t")
    moved = {f"d{c}": F.coalesce((F.col(c) - F.lag(c).over(order)) * s, F.lit(0.0)) for c, s in zip(AXES, spacing, strict=True)}
    out = rows.withColumns(moved | {"dt": F.col("t") - F.lag("t").over(order)})
    length = _norm(F.col("dx"), F.col("dy"), F.col("dz"))
    return out.withColumn("step", length).withColumn("speed", F.when(F.col("dt") > 0, F.col("step") / F.col("dt")).otherwise(F.lit(0.0))).withColumn("dt", F.coalesce("dt", F.lit(0)))


def summary(rows: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """One row per track: points, speeds, path, net displacement, and path over net (null for a track that returns)."""
    s = steps(rows, spacing)
    inner = F.when(F.col("dt") > 0, F.col("speed"))
    ends = {f"net_{c}": (F.max_by(c, "t") - F.min_by(c, "t")) * k for c, k in zip(AXES, spacing, strict=True)}
    per = s.groupBy("track").agg(
        F.count(F.lit(1)).alias("points"),
        F.coalesce(F.avg(inner), F.lit(0.0)).alias("avg_speed"),
        F.coalesce(F.max(inner), F.lit(0.0)).alias("max_speed"),
        F.coalesce(F.min(inner), F.lit(0.0)).alias("min_speed"),
        F.sum("step").alias("path"),
        *(v.alias(k) for k, v in ends.items()),
    )
    per = per.withColumn("net", _norm(*(F.col(f"net_{c}") for c in AXES)))
    return per.withColumn("confinement", F.when(F.col("net") > 0, F.col("path") / F.col("net")))


def directions(rows: DataFrame) -> DataFrame:
    """Step vectors with the cosine against the step before and against the whole path's direction; null where a vector is zero."""
    order = Window.partitionBy("track").orderBy("t")
    whole = Window.partitionBy("track")
    out = rows.withColumns({f"d{c}": F.col(c) - F.lag(c).over(order) for c in AXES}).where("dx is not null")
    out = out.withColumns({f"p{c}": F.lag(f"d{c}").over(order) for c in AXES} | {f"w{c}": F.sum(f"d{c}").over(whole) for c in AXES})

    def cosine(a: str, b: str):
        dot = sum(F.col(f"{a}{c}") * F.col(f"{b}{c}") for c in AXES)
        size = _norm(*(F.col(f"{a}{c}") for c in AXES)) * _norm(*(F.col(f"{b}{c}") for c in AXES))
        return F.when(size > 0, dot / size)

    length = _norm(*(F.col(f"d{c}") for c in AXES))
    return out.select("track", "t", "dx", "dy", "dz", length.alias("step"), cosine("d", "p").alias("turn_cosine"), cosine("d", "w").alias("path_cosine"))


def path_length(rows: DataFrame, key: str, order: str, axes: list[str]) -> DataFrame:
    """Length of the polyline through each key's rows in order."""
    w = Window.partitionBy(key).orderBy(order)
    gap = F.sqrt(sum((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in axes))
    return rows.withColumn("_gap", gap).groupBy(key).agg(F.coalesce(F.sum("_gap"), F.lit(0.0)).alias("length"))


def tile_offsets(tiles: DataFrame, tile: str, key: str) -> DataFrame:
    """Rows with ids that stay unique across tiles: each tile's ids move up by the sum of all earlier tiles' largest ids."""
    top = tiles.groupBy(tile).agg(F.max(key).alias("_top"))
    before = Window.orderBy(tile).rowsBetween(Window.unboundedPreceding, -1)  # one row a tile
    offset = top.select(F.col(tile), F.coalesce(F.sum("_top").over(before), F.lit(0)).alias("_offset"))
    return tiles.join(offset, tile).withColumn("stitched_id", F.col(key) + F.col("_offset")).drop("_offset")


def as_polylines(rows: DataFrame) -> DataFrame:
    """One row per track with its points in time order."""
    return rows.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("t", *AXES))).alias("points"))


def with_classes(rows: DataFrame, classes: DataFrame, by_time: bool) -> DataFrame:
    keys = ["t", "track"] if by_time else ["track"]
    return rows.join(classes.select(*keys, "class"), keys, "left")


def join_tracks(rows: DataFrame, first: int, second: int) -> DataFrame:
    """The second track continues the first, if it begins later; otherwise rows stay as they are."""
    spans = rows.where(F.col("track").isin(first, second)).agg(F.max(F.when(F.col("track") == first, F.col("t"))).alias("end"), F.min(F.when(F.col("track") == second, F.col("t"))).alias("start"))
    told = rows.crossJoin(F.broadcast(spans))  # one row
    moved = F.when((F.col("track") == second) & (F.col("start") > F.col("end")), F.lit(first)).otherwise(F.col("track"))
    return told.withColumn("track", moved.cast(rows.schema["track"].dataType)).select(*rows.columns)


def split_track(rows: DataFrame, track: int, at: int) -> DataFrame:
    """Points of a track from time `at` on get the next free track id."""
    free = rows.agg((F.max("track") + 1).alias("_free"))
    told = rows.crossJoin(F.broadcast(free))  # one row
    return told.withColumn("track", F.when((F.col("track") == track) & (F.col("t") >= at), F.col("_free")).otherwise(F.col("track"))).select(*rows.columns)


def associate(frames: DataFrame, max_distance: float, window: int = 1) -> DataFrame:
    """Greedy one-to-one assignment between each frame and the next `window` ones: a pair stays if it is the closest for both ends.

    Candidates meet in grid cells, so frames are never compared whole.
    """
    cell = F.struct(*(F.floor(F.col(c) / max_distance).cast("long").alias(c) for c in AXES))
    later = frames.select(F.col("t").alias("t2"), F.col("id").alias("id2"), *(F.col(c).alias(f"{c}2") for c in AXES), cell.alias("_cell"))
    near = frames
    for c in AXES:
        near = near.withColumn(f"_{c}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    near = near.withColumn("_cell", F.struct(*((F.floor(F.col(c) / max_distance) + F.col(f"_{c}")).cast("long").alias(c) for c in AXES)))
    pairs = near.join(later, "_cell").where((F.col("t2") > F.col("t")) & (F.col("t2") <= F.col("t") + window))
    distance = F.sqrt(sum((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in AXES))
    pairs = pairs.select("t", "id", "t2", "id2", distance.alias("cost")).where(F.col("cost") <= max_distance)
    out = Window.partitionBy("t", "t2", "id").orderBy("cost", "id2")
    back = Window.partitionBy("t", "t2", "id2").orderBy("cost", "id")
    return pairs.withColumns({"_o": F.row_number().over(out), "_b": F.row_number().over(back)}).where("_o = 1 and _b = 1").drop("_o", "_b")


def with_track_features(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Every point of every time with its track's features, as columns `track_<name>`."""
    named = features.select("track", *(F.col(c).alias(f"track_{c}") for c in features.columns if c != "track"))
    return rows.join(named, "track", "left")


def per_time(rows: DataFrame) -> DataFrame:
    """One row per time: how many tracks it shows, begin and end there, and the mean step that led there; the first time begins nothing, the last ends nothing."""
    span = rows.groupBy("track").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    ends = rows.agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    told = steps(rows).join(span, "track").crossJoin(F.broadcast(ends))  # one row
    begins = (F.col("t") == F.col("first")) & (F.col("t") > F.col("_lo"))
    stops = (F.col("t") == F.col("last")) & (F.col("t") < F.col("_hi"))
    return told.groupBy("t").agg(F.count_distinct("track").alias("tracks"), F.sum(begins.cast("int")).alias("appear"), F.sum(stops.cast("int")).alias("disappear"), F.avg("step").alias("mean_step"))
