"""Objects of one frame assigned to those of the next, with appearing, disappearing, merging and splitting ones.

Candidates are pairs no farther apart than a reach; a pair is worth the reach less its distance, and an object may stay alone for nothing. An
auction finds the assignment: in a round every open object bids for the candidate that is worth most to it at its price, as much as
leaves it no better off with its second choice, plus a step; each candidate goes to its highest bidder, and who had it opens again.
Prices only rise. All frames are auctioned together, a round is a few joins, and in the end the total worth is within a step for each object of
the best there is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessella.operators.graph import kept
from tessella.sources.shared import dropped

AXES = ("x", "y", "z")
#: Pairs of two frames that one task may hold; more are auctioned by joins.
MOST = 2_000_000


def candidates(frames: DataFrame, reach: float, window: int = 1) -> DataFrame:
    """t, id, t2, id2 and worth of all pairs of a frame and one of the next `window` ones within the reach; frames (t, id, x, y, z) meet in grid cells."""
    cell = lambda d=None: F.struct(*((F.floor(F.col(c) / reach) + (F.col(f"_{c}") if d else 0)).cast("long").alias(c) for c in AXES))
    later = frames.select(F.col("t").alias("t2"), F.col("id").alias("id2"), *(F.col(c).alias(f"{c}2") for c in AXES), cell().alias("_cell"))
    near = frames.withColumn("t2", F.explode(F.sequence(F.col("t") + 1, F.col("t") + window)))
    for c in AXES:
        near = near.withColumn(f"_{c}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    near = near.withColumn("_cell", cell(True))
    distance = F.sqrt(sum((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in AXES))
    pairs = near.join(later, ["t2", "_cell"]).withColumn("worth", F.lit(float(reach)) - distance)
    return pairs.where("worth >= 0").select("t", "id", "t2", "id2", "worth")


def _sold(pairs: pa.Table, step: float) -> pa.Table:
    """The auction of two frames' pairs, by the same rounds and bids as `_rounds`."""
    pairs = pairs.sort_by([("id", "ascending"), ("id2", "ascending")])
    ids, own = np.unique(pairs["id"].to_numpy(), return_inverse=True)
    _, item = np.unique(pairs["id2"].to_numpy(), return_inverse=True)
    worth, starts = pairs["worth"].to_numpy(), np.searchsorted(own, np.arange(len(ids) + 1))
    price, row = np.zeros(item.max() + 1), {}  # the pair that holds an item
    open_ = range(len(ids))
    while open_:
        bids: dict[int, tuple[float, int]] = {}
        lost = []
        for who in open_:
            low, high = starts[who], starts[who + 1]
            left = worth[low:high] - price[item[low:high]]
            k = int(left.argmax())
            most = left[k]
            if not most > 0:
                continue
            left[k] = -np.inf
            what = int(item[low + k])
            bid = price[what] + most - max(left.max(), 0.0) + step
            # Those who bid come in order, so that ties stay with the smaller id.
            if what not in bids or bid > bids[what][0]:
                if what in bids:
                    lost.append(int(own[bids[what][1]]))
                bids[what] = (bid, low + k)
            else:
                lost.append(who)
        for what, (bid, at) in bids.items():
            if what in row:
                lost.append(int(own[row[what]]))
            price[what], row[what] = bid, at
        open_ = sorted(lost)
    return pairs.take(pa.array(sorted(row.values()), pa.int64()))


def auction(pairs: DataFrame, step: float) -> DataFrame:
    """t, id, t2, id2 and worth of the pairs of an assignment that is one to one between any two frames.

    For each (t, t2) the total is at least the best possible one less `step` for every object of t. Ties in bids go to the smaller id.
    Frames with at most `MOST` pairs are auctioned by one task, since an auction has thousands of rounds; all give the same rows.
    """
    pairs = kept(pairs.select("t", "id", "t2", "id2", "worth"))
    many = kept(pairs.groupBy("t", "t2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST).select("t", "t2"))
    few = pairs.join(many, ["t", "t2"], "left_anti").select("t", "id", "t2", "id2", "worth").groupBy("t", "t2").applyInArrow(lambda table: _sold(table, step), pairs.schema)
    return few if many.isEmpty() else few.unionByName(_rounds(pairs.join(many, ["t", "t2"], "left_semi"), step))


def _rounds(pairs: DataFrame, step: float) -> DataFrame:
    """The auction of all frames together, by joins: a round for all bids."""
    own, item = ["t", "t2", "id"], ["t", "t2", "id2"]
    pairs = kept(pairs.select("t", "t2", "id", "id2", "worth"))
    prices = kept(pairs.select(*item).distinct().select(*item, F.lit(0.0).alias("price"), F.lit(None).cast(pairs.schema["id"].dataType).alias("owner")))
    open_ = kept(pairs.select(*own).distinct())
    best = Window.partitionBy(*own).orderBy(F.col("left").desc(), "id2")
    while not open_.isEmpty():
        asked = pairs.join(open_, own).join(prices.select(*item, "price"), item).withColumn("left", F.col("worth") - F.col("price"))
        two = asked.withColumns({"_n": F.row_number().over(best), "_next": F.lead("left").over(best)}).where("_n = 1 and left > 0")
        bid = two.select(*item, "id", (F.col("price") + F.col("left") - F.greatest(F.coalesce("_next", F.lit(0.0)), F.lit(0.0)) + step).alias("bid"))
        won = kept(bid.groupBy(*item).agg(F.min(F.struct((-F.col("bid")).alias("b"), F.col("id"))).alias("w"), F.collect_list("id").alias("bidders")))
        told = kept(prices.join(won, item, "left").select(*item, F.coalesce(-F.col("w.b"), F.col("price")).alias("price"), F.coalesce("w.id", "owner").alias("owner"), F.when(F.col("w").isNotNull(), F.array_append(F.array_remove("bidders", F.col("w.id")), F.col("owner"))).alias("lost")))
        before, open_ = open_, kept(told.select("t", "t2", F.explode("lost").alias("id")).where("id is not null"))
        dropped(before, prices, won)
        prices = told.select(*item, "price", "owner")
        prices.written_to = getattr(told, "written_to", None)
    held = prices.where("owner is not null").select(*item, F.col("owner").alias("id"))
    return held.join(pairs, [*item, "id"]).select("t", "id", "t2", "id2", "worth")


def track_events(frames: DataFrame, reach: float, step: float | None = None, split: bool = True) -> DataFrame:
    """t, id, t2, id2 and event between each frame and the next: move, split, merge, appear or disappear.

    Moves are the auction's. An object of the next frame that none moves to, but that has a candidate, split off the one worth
    most; likewise one that moves nowhere merged into its best candidate; all others appear, or disappear. The first frame's objects don't appear, nor
    do the last one's disappear.
    """
    pairs = kept(candidates(frames, reach))
    moves = kept(auction(pairs, reach / 1000 if step is None else step).select("t", "id", "t2", "id2"))
    out = moves.withColumn("event", F.lit("move"))
    ends = frames.agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    told = frames.select("t", "id").crossJoin(F.broadcast(ends))  # one row
    fresh = told.where("t > _lo").select(F.col("t").alias("t2"), F.col("id").alias("id2")).join(moves.select("t2", "id2"), ["t2", "id2"], "left_anti")
    gone = told.where("t < _hi").select("t", "id").join(moves.select("t", "id"), ["t", "id"], "left_anti")
    if split:
        came = pairs.join(fresh, ["t2", "id2"]).groupBy("t2", "id2").agg(F.min(F.struct((-F.col("worth")).alias("w"), "id", "t")).alias("m")).select(F.col("m.t").alias("t"), F.col("m.id").alias("id"), "t2", "id2")
        went = pairs.join(gone, ["t", "id"]).groupBy("t", "id").agg(F.min(F.struct((-F.col("worth")).alias("w"), "id2", "t2")).alias("m")).select("t", "id", F.col("m.t2").alias("t2"), F.col("m.id2").alias("id2"))
        # Two that are left and have each other would have moved.
        came, went = kept(came), kept(went)
        out = out.unionByName(came.withColumn("event", F.lit("split"))).unionByName(went.withColumn("event", F.lit("merge")))
        fresh, gone = fresh.join(came.select("t2", "id2"), ["t2", "id2"], "left_anti"), gone.join(went.select("t", "id"), ["t", "id"], "left_anti")
    none = F.lit(None).cast(frames.schema["id"].dataType)
    out = out.unionByName(fresh.select((F.col("t2") - 1).cast(frames.schema["t"].dataType).alias("t"), none.alias("id"), "t2", "id2", F.lit("appear").alias("event")))
    return out.unionByName(gone.select("t", "id", (F.col("t") + 1).cast(frames.schema["t"].dataType).alias("t2"), none.alias("id2"), F.lit("disappear").alias("event")))
