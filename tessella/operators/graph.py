"""Graphs as vertex and edge tables: components, spanning forests, hops; and parent-pointer forests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.sources.shared import dropped, written


def kept(df: DataFrame) -> DataFrame:
    """Written once to the session's shared folder and read back, so that lineage stays short."""
    return written(df, "graph")


#: Rows of a table that may be broadcast. Spark goes by the size of files, and ids in order compress to a fraction of what they are in the driver's memory.
BROADCAST = 200_000


def unbroadcast(table: DataFrame, rows: int) -> DataFrame:
    """The table, met by sorting instead of a broadcast if there are many rows of its kind."""
    return table.hint("merge") if rows > BROADCAST else table


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every vertex, by contracting each vertex into its smallest neighbour."""
    labels = kept(vertices.select("id", F.col("id").alias("component")))
    rows = labels.count()
    left = kept(edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct())
    while not left.isEmpty():
        near = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
        down = kept(near.select(F.col("a").alias("v"), F.least("a", "b").alias("to")))
        side = unbroadcast(down, rows)
        jump = kept(down.alias("x").join(side.alias("y"), F.col("x.to") == F.col("y.v"), "left").select(F.col("x.v").alias("v"), F.coalesce("y.to", "x.to").alias("to")))
        a, b = unbroadcast(jump.toDF("a", "_a"), rows), unbroadcast(jump.toDF("b", "_b"), rows)
        before, left = left, kept(left.join(a, "a").join(b, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).where("a <> b").distinct())
        old, labels = labels, kept(labels.join(unbroadcast(jump, rows), F.col("component") == F.col("v"), "left").select("id", F.coalesce("to", "component").alias("component")))
        dropped(before, old, down, jump)
    return labels


def spanning_forest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Minimum spanning forest by Boruvka: in each round every component takes its lightest edge out, ties by ends.

    Edges carry the components of their ends and are dropped once these are one, so rounds shrink by half at least.
    """
    ends = ["source", "target"]
    unique = edges.groupBy(F.least(*ends).alias("source"), F.greatest(*ends).alias("target")).agg(F.min("distance").alias("distance")).where("source <> target")
    out = kept(unique.select(F.col("source").alias("_a"), F.col("target").alias("_b"), F.struct("distance", "source", "target").alias("_e")))
    taken = []
    while not out.isEmpty():
        best = kept(out.select(F.col("_a").alias("_c"), "_a", "_b", "_e").unionByName(out.select(F.col("_b").alias("_c"), "_a", "_b", "_e")).groupBy("_c").agg(F.min(F.struct("_e", "_a", "_b")).alias("_m")).select("_m.*").distinct())
        taken.append(best.select("_e.source", "_e.target", "_e.distance"))
        both = best.select(F.explode(F.array("_a", "_b")).alias("id")).distinct()
        place = components(both, best.select(F.col("_a").alias("source"), F.col("_b").alias("target")))
        at, to = place.toDF("_a", "_na"), place.toDF("_b", "_nb")
        moved = out.join(at, "_a", "left").join(to, "_b", "left").select(F.coalesce("_na", "_a").alias("_a"), F.coalesce("_nb", "_b").alias("_b"), "_e")
        out = kept(moved.where("_a <> _b"))
    if not taken:
        return unique.limit(0)
    return reduce(DataFrame.unionByName, taken)


def hops(edges: DataFrame, start: Column | int, most: int) -> DataFrame:
    """Vertices within `most` steps of the start, with the least number of steps."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    seen = both.select(F.lit(start).cast("long").alias("id"), F.lit(0).alias("hops")).limit(1)
    front = seen
    for k in range(1, most + 1):
        step = both.join(front.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        front = kept(step.join(seen, "id", "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        seen = kept(seen.unionByName(front))
    return seen


def between(first: DataFrame, second: DataFrame, last: int) -> DataFrame:
    """Vertices on a shortest way: hops from the first plus hops to the second equal the distance of the two."""
    whole = first.where(F.col("id") == last).select(F.col("hops").alias("_whole"))
    both = first.select("id", F.col("hops").alias("from_start")).join(second.select("id", F.col("hops").alias("to_end")), "id")
    return both.crossJoin(F.broadcast(whole)).where("from_start + to_end = _whole").select("id", "from_start", "to_end")  # one row


def forest_depths(nodes: DataFrame) -> DataFrame:
    """id, root and depth of every node of a table (id, parent); a root has a null or negative parent.

    Pointer jumping: each round doubles the steps that a node's pointer spans, so a chain of n nodes takes log n rounds.
    """
    rooted = F.col("parent").isNull() | (F.col("parent") < 0)
    ptr = kept(nodes.select("id", F.when(rooted, F.col("id")).otherwise(F.col("parent")).alias("up"), F.when(rooted, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("depth")))
    while True:
        above = ptr.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        far = kept(ptr.join(above, "up", "left").select("id", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), (F.coalesce("_up", F.col("up")) != F.col("up")).alias("_moved")))
        if far.where("_moved").isEmpty():
            return far.select("id", F.col("up").alias("root"), "depth")
        dropped(ptr)
        ptr = far.drop("_moved")
        ptr.written_to = getattr(far, "written_to", None)


def ancestors(nodes: DataFrame) -> list[DataFrame]:
    """Tables of id and `up`, the ancestor 1, 2, 4, .. steps above every node, as far as the deepest tree needs; a root's is itself."""
    rooted = F.col("parent").isNull() | (F.col("parent") < 0)
    tables = [kept(nodes.select("id", F.when(rooted, F.col("id")).otherwise(F.col("parent")).alias("up")))]
    while True:
        last = tables[-1]
        far = kept(last.join(last.select(F.col("id").alias("up"), F.col("up").alias("_up")), "up").select("id", F.col("_up").alias("up"), (F.col("_up") != F.col("up")).alias("moved")))
        if far.where("moved").isEmpty():
            return tables
        tables.append(far.drop("moved"))


def tree_distances(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, meet, steps and distance of each pair (a, b): their lowest common ancestor, and the steps and length of the way between; null in different trees.

    `nodes` has id, parent and length, that of the way to the parent. Both ends rise by powers of two: the lower one to the height of the
    other, then both as long as they differ. So a pair takes part in two joins for each power, and no pair meets another.
    """
    place = forest_depths(nodes)
    rooted = F.col("parent").isNull() | (F.col("parent") < 0)
    tables = ancestors(nodes)
    # Lengths to the root double their reach with the tables of ancestors.
    far = kept(nodes.select("id", F.when(rooted, F.lit(0.0)).otherwise(F.col("length").cast("double")).alias("far")))
    for table in tables:
        above = far.select(F.col("id").alias("up"), F.col("far").alias("_far"))
        before, far = far, kept(far.join(table, "id").join(above, "up").select("id", F.when(F.col("up") == F.col("id"), F.col("far")).otherwise(F.col("far") + F.col("_far")).alias("far")))
        dropped(before)
    told = kept(place.join(far, "id"))
    state = pairs.select("a", "b").distinct()
    for end in ("a", "b"):
        state = state.join(told.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}"), F.col("depth").alias(f"depth_{end}"), F.col("far").alias(f"far_{end}")), end)
    lower = F.col("depth_a") >= F.col("depth_b")
    state = kept(state.withColumns({"u": F.when(lower, F.col("a")).otherwise(F.col("b")), "v": F.when(lower, F.col("b")).otherwise(F.col("a")), "rest": F.abs(F.col("depth_a") - F.col("depth_b"))}))
    apart, state = state.where("root_a <> root_b"), state.where("root_a = root_b")
    for k, table in enumerate(tables):
        up = table.select(F.col("id").alias("u"), F.col("up").alias("_u"))
        state = state.join(up, "u").withColumn("u", F.when(F.shiftright("rest", k).bitwiseAND(1) == 1, F.col("_u")).otherwise(F.col("u"))).drop("_u")
        if k % 4 == 3:
            state = kept(state)
    for k, table in reversed(list(enumerate(tables))):
        state = state.join(table.select(F.col("id").alias("u"), F.col("up").alias("_u")), "u").join(table.select(F.col("id").alias("v"), F.col("up").alias("_v")), "v")
        goes = F.col("_u") != F.col("_v")
        state = state.withColumns({"u": F.when(goes, F.col("_u")).otherwise(F.col("u")), "v": F.when(goes, F.col("_v")).otherwise(F.col("v"))}).drop("_u", "_v")
        if k % 4 == 3:
            state = kept(state)
    state = state.join(tables[0].select(F.col("id").alias("u"), F.col("up").alias("_u")), "u").withColumn("meet", F.when(F.col("u") == F.col("v"), F.col("u")).otherwise(F.col("_u")))
    state = state.join(told.select(F.col("id").alias("meet"), F.col("depth").alias("_depth"), F.col("far").alias("_far")), "meet")
    found = state.select("a", "b", "meet", (F.col("depth_a") + F.col("depth_b") - 2 * F.col("_depth")).alias("steps"), (F.col("far_a") + F.col("far_b") - 2 * F.col("_far")).alias("distance"))
    none = F.lit(None)
    return found.unionByName(apart.select("a", "b", none.cast(found.schema["meet"].dataType).alias("meet"), none.cast("long").alias("steps"), none.cast("double").alias("distance")))


def segments(nodes: DataFrame) -> DataFrame:
    """Per node: distance to its parent, taper, volume and surface of the piece between (a root is a ball of its radius)."""
    up = nodes.select(F.col("id").alias("parent"), *(F.col(c).alias(f"_{c}") for c in ("x", "y", "z", "r")))
    told = nodes.join(up, "parent", "left")
    length = F.sqrt(sum((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in ("x", "y", "z")))
    told = told.withColumn("length", F.coalesce(length, F.lit(0.0)))
    pi = F.lit(3.141592653589793)
    ball = F.col("_r").isNull()
    return told.select(
        "id",
        "parent",
        "length",
        F.when(F.col("length") > 0, 2 * (F.col("_r") - F.col("r")) / F.col("length")).alias("burke_taper"),
        F.when(F.col("_r") > 0, (F.col("_r") - F.col("r")) / F.col("_r")).alias("hillman_taper"),
        F.when(ball, 4.0 / 3.0 * pi * F.pow("r", F.lit(3.0))).otherwise(pi * F.col("r") * F.col("r") * F.col("length")).alias("volume"),
        F.when(ball, 4.0 * pi * F.col("r") * F.col("r")).otherwise(2 * pi * F.col("r") * F.col("length")).alias("surface"),
    )


def cell_table(nodes: DataFrame) -> DataFrame:
    """One row per tree: nodes, leaves, branch points, depth, and sums and ranges of the segment measures."""
    place = forest_depths(nodes)
    children = nodes.where("parent is not null and parent >= 0").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    told = segments(nodes).join(place, "id").join(children, "id", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    measures = ("length", "volume", "surface")
    return told.groupBy("root").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.sum((F.col("children") == 0).cast("long")).alias("leaves"),
        F.sum((F.col("children") > 1).cast("long")).alias("branch_points"),
        F.max("depth").alias("max_depth"),
        *(f(m).alias(f"{n}_{m}") for m in measures for n, f in (("total", F.sum), ("min", F.min), ("mean", F.avg), ("max", F.max))),
    )


def bifurcations(nodes: DataFrame) -> DataFrame:
    """Per node with exactly two children: daughter ratio, local amplitude in degrees, Pk at 1.5 and 2, Hillman threshold, and partition asymmetry."""
    kids = nodes.where("parent >= 0").groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y", "z", "r"))).alias("k")).where(F.size("k") == 2)
    told = nodes.join(kids.withColumnRenamed("parent", "id"), "id")
    leaf = leaf_counts(nodes)
    a, b = F.col("k")[0], F.col("k")[1]
    told = told.withColumns({"_a": a, "_b": b})
    told = told.join(leaf.select(F.col("id").alias("_ia"), F.col("leaves").alias("_la")), F.col("_a.id") == F.col("_ia")).join(leaf.select(F.col("id").alias("_ib"), F.col("leaves").alias("_lb")), F.col("_b.id") == F.col("_ib"))
    va, vb = ([F.col(f"{s}.{c}") - F.col(c) for c in ("x", "y", "z")] for s in ("_a", "_b"))
    dot = sum(p * q for p, q in zip(va, vb, strict=True))
    size = F.sqrt(sum(p * p for p in va)) * F.sqrt(sum(q * q for q in vb))
    cosine = F.when(size > 0, F.least(F.greatest(dot / size, F.lit(-1.0)), F.lit(1.0)))
    pk = lambda n: (F.pow(F.col("_a.r"), F.lit(n)) + F.pow(F.col("_b.r"), F.lit(n))) / F.pow(F.col("r"), F.lit(n))
    asym = F.when(F.col("_la") + F.col("_lb") > 2, F.abs(F.col("_la") - F.col("_lb")) / (F.col("_la") + F.col("_lb") - 2)).otherwise(F.lit(1.0))
    return told.select(
        "id",
        (F.greatest("_a.r", "_b.r") / F.least("_a.r", "_b.r")).alias("daughter_ratio"),
        F.degrees(F.acos(cosine)).alias("amplitude"),
        pk(1.5).alias("pk_classic"),
        pk(2.0).alias("pk_2"),
        (0.5 * F.col("r") + 0.25 * F.col("_a.r") + 0.25 * F.col("_b.r")).alias("hillman_threshold"),
        asym.alias("partition_asymmetry"),
    )


def subtree(nodes: DataFrame, value: Column, how: str = "sum") -> DataFrame:
    """id and `value`, summed (or the largest) over each node and all nodes below it.

    A node's pointer spans twice the steps after each round, and it hands its own result on to where it points:
    that covers exactly the nodes one reach farther down, so a chain of n nodes takes log n rounds.
    """
    pick = {"sum": F.sum, "max": F.max}[how]
    state = kept(nodes.select("id", F.when(F.col("parent") >= 0, F.col("parent")).alias("up"), value.alias("value")))
    while not (moving := state.where("up is not null")).isEmpty():
        handed = moving.groupBy(F.col("up").alias("id")).agg(pick("value").alias("_more"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"))
        merged = F.col("value") + F.coalesce("_more", F.lit(0)) if how == "sum" else F.greatest("value", "_more")
        state = kept(state.join(handed, "id", "left").join(above, "up", "left").select("id", F.col("_up").alias("up"), merged.alias("value")))
    return state.select("id", "value")


def leaf_counts(nodes: DataFrame) -> DataFrame:
    """Leaves at or below every node."""
    inner = nodes.where("parent >= 0").select(F.col("parent").alias("id")).distinct().withColumn("_inner", F.lit(1))
    told = nodes.select("id", "parent").join(inner, "id", "left")
    return subtree(told, F.col("_inner").isNull().cast("long")).withColumnRenamed("value", "leaves")


def backbone(nodes: DataFrame) -> DataFrame:
    """root and id of the nodes on the longest path of each tree, by steps; ties go to smaller ids.

    The path turns at the node whose two deepest branches reach farthest together, and follows in both of them
    the deepest child.
    """
    place = kept(forest_depths(nodes))
    deepest = subtree(nodes.select("id", "parent").join(place, "id"), F.col("depth"), "max").withColumnRenamed("value", "_deepest")
    tall = kept(nodes.select("id", "parent").join(place, "id").join(deepest, "id").withColumn("height", F.col("_deepest") - F.col("depth")).drop("_deepest"))
    kids = tall.where("parent >= 0").select("parent", "id", F.struct("height", (-F.col("id")).alias("_i")).alias("_s"))
    first = kids.groupBy("parent").agg(F.max("_s").alias("_1"))
    rest = kids.join(first, "parent").where(F.col("_s._i") != F.col("_1._i"))
    second = rest.groupBy("parent").agg(F.max("_s").alias("_2"))
    best = first.join(second, "parent", "left").select(F.col("parent").alias("id"), (-F.col("_1._i")).alias("one"), (-F.col("_2._i")).alias("two"), (F.col("_1.height") + 1 + F.coalesce(F.col("_2.height") + 1, F.lit(0))).alias("span"))
    told = kept(tall.join(best, "id", "left"))
    apex = kept(told.groupBy("root").agg(F.max(F.struct(F.coalesce("span", F.lit(0)).alias("span"), (-F.col("id")).alias("_i"), "one", "two")).alias("_a")).select("root", (-F.col("_a._i")).alias("apex"), "_a.one", "_a.two"))
    favourite = told.where("one is not null").select(F.col("id").alias("parent"), F.col("one").alias("_one"))
    cut = told.join(favourite, "parent", "left").join(apex.select(F.col("apex").alias("parent"), F.lit(True).alias("_top")), "parent", "left")
    chains = forest_depths(cut.select("id", F.when((F.col("_one") == F.col("id")) & F.col("_top").isNull(), F.col("parent")).otherwise(F.lit(-1)).alias("parent")))
    tops = apex.select("root", F.explode(F.array("one", "two")).alias("_chain")).where("_chain is not null")
    along = chains.select("id", F.col("root").alias("_chain")).join(tops, "_chain").select("root", "id")
    return along.unionByName(apex.select("root", F.col("apex").alias("id")))


def chords(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges outside the minimum spanning forest: each closes one independent cycle."""
    unique = edges.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.min("distance").alias("distance")).where("source <> target")
    return unique.join(spanning_forest(vertices, edges).select("source", "target"), ["source", "target"], "left_anti")


def cycle_rank(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """component, vertices, edges and number of independent cycles; a component is a tree if that is 0."""
    place = components(vertices, edges)
    unique = edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).where("source <> target").distinct()
    lines = unique.join(place.select(F.col("id").alias("source"), "component"), "source").groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    sizes = place.groupBy("component").agg(F.count(F.lit(1)).alias("vertices"))
    told = sizes.join(lines, "component", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return told.withColumn("cycles", F.col("edges") - F.col("vertices") + 1)


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between the chosen ids."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(*edges.columns)


def colouring(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id and colour (from 1), neighbours different: in each round all vertices whose hash beats those of their uncoloured neighbours take the smallest free colour."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source <> target").distinct()
    rank = F.struct(F.xxhash64("id").alias("h"), "id")
    done, open_ = None, kept(vertices.select("id", rank.alias("rank")))
    both = kept(both)
    while not open_.isEmpty():
        near = both.join(open_.select(F.col("id").alias("target"), F.col("rank").alias("_r")), "target").groupBy(F.col("source").alias("id")).agg(F.max("_r").alias("_r"))
        free = open_.join(near, "id", "left").where(F.col("_r").isNull() | (F.col("rank") > F.col("_r"))).select("id")
        if done is None:
            fresh = free.withColumn("colour", F.lit(1))
        else:
            # As many colours at most as there are in use.
            taken = both.join(free.select(F.col("id").alias("source")), "source").join(done.select(F.col("id").alias("target"), "colour"), "target").groupBy(F.col("source").alias("id")).agg(F.collect_set("colour").alias("_c"))
            smallest = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("_c") + 1), F.col("_c")))
            fresh = free.join(taken, "id", "left").select("id", F.when(F.col("_c").isNull(), F.lit(1)).otherwise(smallest).alias("colour"))
        fresh = kept(fresh)
        done = fresh if done is None else kept(done.unionByName(fresh))
        open_ = kept(open_.join(fresh.select("id"), "id", "left_anti"))
    return done if done is not None else vertices.select("id", F.lit(1).alias("colour"))


def reroot(nodes: DataFrame, tree_root: int, new_root: int) -> DataFrame:
    """Reverse the pointers between a tree's root and the new one."""
    path = hops_up(nodes, new_root)
    flipped = path.select(F.col("parent").alias("id"), F.col("id").alias("_new")).where("id >= 0")
    told = nodes.join(flipped, "id", "left")
    return told.withColumn("parent", F.when(F.col("id") == new_root, F.lit(-1)).otherwise(F.coalesce("_new", "parent")).cast(nodes.schema["parent"].dataType)).select(*nodes.columns)


def hops_up(nodes: DataFrame, start: int) -> DataFrame:
    """id and parent of the nodes from `start` up to its root; the way doubles in each round."""
    up = nodes.select("id", "parent")
    jump = kept(up.where("parent >= 0").select("id", F.col("parent").alias("far")))
    seen = kept(up.where(F.col("id") == start).select("id"))
    while not (more := kept(seen.join(jump, "id").select(F.col("far").alias("id")))).isEmpty():
        seen = kept(seen.unionByName(more))
        jump = kept(jump.join(jump.select(F.col("id").alias("far"), F.col("far").alias("_far")), "far").select("id", F.col("_far").alias("far")))
    return up.join(seen, "id", "left_semi")


def _beside(ends: DataFrame) -> DataFrame:
    """Ends with `above` and `below`: of other trees' ends at the same place, the next line after theirs and the first line if before theirs."""
    up = Window.partitionBy("x", "y", "z").orderBy("line")
    down = Window.partitionBy("x", "y", "z").orderBy(F.col("line").desc())
    # Where the tree changes, the line after is the next one of another tree for all before.
    told = ends.withColumns({"_l": F.lag("line").over(down), "_r": F.lag("root").over(down)})
    told = told.withColumn("above", F.last(F.when(F.col("_r") != F.col("root"), F.col("_l")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.withColumns({"_f": F.first("line").over(up.rowsBetween(Window.unboundedPreceding, 0)), "_g": F.first("root").over(up.rowsBetween(Window.unboundedPreceding, 0))})
    other = F.min(F.when(F.col("root") != F.col("_g"), F.col("line"))).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The first line of a tree other than that of the place's first line is of no use to its own tree.
    return told.withColumn("below", F.when(F.col("root") != F.col("_g"), F.col("_f")).when(other.isNotNull(), other)).drop("_l", "_r", "_f", "_g")


def _cheapest(asked: DataFrame, ends: DataFrame, max_gap: float, up: bool) -> DataFrame:
    """line, other, gap and cost of the cheapest partner within `max_gap` of each line of `asked`, among later lines (`up`) or earlier ones; ties to the smaller line.

    Cells grow up to `max_gap`. A line is settled once its best costs less than any partner that is farther away than the cell size can.
    Cells that hold no line on the right side of another tree are left out. A partial minimum goes to the shuffle, not the pairs.
    """
    axes = ("x", "y", "z")
    cell = lambda size: F.struct(*(F.floor(F.col(c) / size).cast("long").alias(c) for c in axes))
    far = F.max if up else F.min

    def halls(size: float) -> DataFrame:
        """Per cell the farthest line, its tree, and the farthest line of any other tree."""
        trees = ends.groupBy(cell(size).alias("_cell"), F.col("root").alias("_g")).agg(far("line").alias("_l"))
        order = Window.partitionBy("_cell").orderBy(F.col("_l").desc() if up else F.col("_l"), "_g")
        told = trees.withColumn("_n", F.row_number().over(order)).where("_n <= 2")
        return told.groupBy("_cell").agg(*(F.max(F.when(F.col("_n") == n, F.col(c))).alias(f"{c}{n}") for n in (1, 2) for c in ("_l", "_g")))

    def around(table: DataFrame, size: float) -> DataFrame:
        """Lines with the cells about them that hold some line to ask."""
        for c in axes:
            table = table.withColumn(f"_{c}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
        moved = F.struct(*((F.floor(F.col(c) / size) + F.col(f"_{c}")).cast("long").alias(c) for c in axes))
        some = F.when(F.col("root") != F.col("_g1"), F.col("_l1")).otherwise(F.col("_l2"))
        return table.withColumn("_cell", moved).join(halls(size), "_cell").where(some > F.col("line") if up else some < F.col("line")).select("line", "root", *axes, "length", "_cell")

    facts = ends.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("most")).first()
    if not facts["n"]:
        return asked.select("line", F.col("line").alias("other"), F.lit(0.0).alias("gap"), F.lit(0.0).alias("cost")).limit(0)
    open_ = kept(around(asked, max_gap).select("line", "root", *axes, "length").distinct())
    size, crowd = float(max_gap), float("inf")
    while True:
        shared = ends.groupBy(cell(size)).agg(F.count(F.lit(1)).alias("c")).agg((F.sum(F.col("c").cast("double") * F.col("c")) / F.sum("c")).alias("m")).first()["m"]
        if shared > 0.9 * crowd:  # ends at the same places stay together
            size *= 2
            break
        if shared <= 16 or size < max_gap * 2.0**-20:
            break
        size, crowd = size / 2, shared
    out = []
    while True:
        last = size >= max_gap
        later = ends.select(cell(size).alias("_cell"), F.col("line").alias("other"), F.col("root").alias("_root"), F.col("length").alias("_length"), *(F.col(c).alias(f"{c}2") for c in axes))
        # The difference is taken from the earlier line to the later one, as in the sum of the lengths.
        pairs = around(open_, size).join(later, "_cell").where((F.col("other") > F.col("line") if up else F.col("other") < F.col("line")) & (F.col("root") != F.col("_root")))
        pairs = pairs.withColumn("gap", F.sqrt(sum((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in axes))).where(F.col("gap") <= size)
        first, second = ("length", "_length") if up else ("_length", "length")
        total = F.col("gap") + F.col(first) + F.col(second)
        pairs = pairs.withColumn("cost", F.when(total > 0, F.col("gap") / max_gap * (F.col("gap") / F.nullif(total, F.lit(0.0)))).otherwise(F.lit(0.0)))
        best = pairs.groupBy("line").agg(F.min(F.struct("cost", "other", "gap")).alias("_b"), F.max("length").alias("length"))
        # No pair that is farther apart than the cell size costs less than this.
        beyond = size / max_gap * (size / (size + F.col("length") + facts["most"])) * (1 - 1e-9)
        sure = F.lit(True) if last else F.col("_b.cost") < beyond
        found = kept(best.where(sure).select("line", F.col("_b.other").alias("other"), F.col("_b.gap").alias("gap"), F.col("_b.cost").alias("cost")))
        out.append(found)
        if last:
            return reduce(DataFrame.unionByName, out)
        before, open_ = open_, kept(open_.join(found.select("line"), "line", "left_anti"))
        dropped(before)
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, out)
        size = min(2 * size, float(max_gap))


def gaps(ends: DataFrame, max_gap: float) -> DataFrame:
    """Closest pairs of line ends (line, root, x, y, z, length) of different trees within `max_gap`; each line keeps its cheapest.

    The cost is the distance over the largest allowed, times the share of the gap in the joined length; `length` and `root` are the line's, the same at
    all its ends. Two lines are a pair if each is the other's cheapest, ties to the smaller line. Ends at one place cost
    nothing, so the lines in order tell their partners; only the other lines are compared, see `_cheapest`.
    """
    axes = ("x", "y", "z")
    real = reduce(lambda a, b: a & b, (F.abs(c) < float("inf") for c in axes))
    ends = kept(ends.select("line", "root", *(F.col(c).cast("double").alias(c) for c in axes), F.col("length").cast("double").alias("length")).where(real & F.col("line").isNotNull() & F.col("root").isNotNull()))
    beside = kept(_beside(ends).groupBy("line").agg(F.min("above").alias("above"), F.min("below").alias("below")))

    def told(asked: DataFrame, side: str, up: bool) -> DataFrame:
        here = asked.join(beside, "line")
        free = F.lit(0.0)
        near = here.where(F.col(side).isNotNull()).select("line", F.col(side).alias("other"), free.alias("gap"), free.alias("cost"))
        rest = kept(ends.join(here.where(F.col(side).isNull()).select("line"), "line", "left_semi"))
        return near.unionByName(_cheapest(rest, ends, max_gap, up))

    forth = kept(told(beside.select("line"), "above", True))
    back = told(forth.select(F.col("other").alias("line")).distinct(), "below", False).select(F.col("line").alias("line2"), F.col("other").alias("line"))
    return forth.withColumnRenamed("other", "line2").join(back, ["line", "line2"]).select("line", "line2", "gap", "cost")
