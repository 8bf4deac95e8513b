"""Mixing sources to target weights by capped water-filling (operator 5).

A source's target is its weight's share of all words, but at most `epochs` times its own size; the excess
goes to the others by weight until none is above its cap. The common level is found in closed form from
running sums over the sources in the order in which they reach their caps. A source is then taken a whole
number of times, plus a seeded sample of whole documents for the fraction.

Null texts have size 0; taking them or not changes nothing. A null source is a source of its own, last in order.
Repeated rows are separate documents, drawn by a hash of id and text; only rows equal in both tie, and those that tie at
the edge of a sample are taken in order of size. Texts of any length are counted where they lie. `mixture` returns extra
columns, whatever their names; `mix` ignores them. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.llm.stage import written

WORD = "[^\\x20\\x09-\\x0D]+"
BINS = 4096


def seeded(key: Column, text: Column, seed: int) -> Column:
    """A 52-bit number drawn from the key and the text, so that rows without a key don't share one; the same on every run."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, epochs: int = 3, weights: int = 3) -> DataFrame:
    """source, source_size and target for a table of (source, size).

    Sources by code point, null last, weigh 1, 2, .., `weights`, repeating. Windows here run over one row
    per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = per_source.withColumn("weight", ((rank - 1) % weights + 1).cast("long"))
    weighed = weighed.withColumn("cap", F.lit(epochs) * F.col("source_size"))
    by_need = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy())
    # The level never lies below any of these: each bounds the filled volume from above.
    stepped = weighed.withColumns({"_before": before, "_open": open_weight, "_whole": whole})
    level = F.max((F.col("_whole") - F.col("_before")).cast("double") / F.col("_open").cast("double")).over(Window.partitionBy())
    filled = stepped.withColumn("_level", level)
    return filled.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("_level") * F.col("weight")).alias("target"))


def _sized(docs: DataFrame, seed: int, *carried: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    drawn = seeded(F.col("doc_id"), F.col("text"), seed)
    own = docs.select(*(F.col(c).alias(f"_in_{c}") for c in carried), "doc_id", "source", size.alias("size"), drawn.alias("_u"))
    return own.withColumn("_bin", F.shiftright(F.col("_u"), 40))  # the upper 12 of 52 bits


def _source_plan(sizes: DataFrame, epochs: int) -> DataFrame:
    """How often each source is taken whole, the words left to sample, and the bin in which they run out."""
    goal = targets(sizes, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    # From at most BINS sums a source.
    sums = sizes.groupBy("source", "_bin").agg(F.sum("size").alias("_sum"))
    running = F.sum("_sum").over(Window.partitionBy("source").orderBy("_bin"))
    bins = sums.withColumn("_end", running).withColumnRenamed("source", "_s")
    bins = bins.join(goal.select(F.col("source").alias("_g"), "_rest"), F.col("_s").eqNullSafe(F.col("_g")))
    edge = bins.where(F.col("_end") > F.col("_rest")).groupBy("_s").agg(F.min(F.struct("_bin", (F.col("_end") - F.col("_sum")).alias("start"))).alias("_edge"))
    return goal.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_p"), "source_size", "target", "_whole", "_rest", F.col("_edge._bin").alias("_cut"), F.col("_edge.start").alias("_start"))


def _copied(rows: DataFrame, plan: DataFrame, epochs: int) -> DataFrame:
    """`rows` with `copies`, by a plan of one row per source."""
    told = rows.join(plan, F.col("source").eqNullSafe(F.col("_p")), "left")
    at_edge = F.coalesce(F.col("_bin") == F.col("_cut"), F.lit(False))
    clear = told.where(~at_edge).withColumn("_extra", F.coalesce(F.col("_bin") < F.col("_cut"), F.lit(True)).cast("long"))
    # Only the documents of one bin in 4096 of a source need an order.
    order = Window.partitionBy("source").orderBy("_u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_start") + F.coalesce(F.sum("size").over(order), F.lit(0))
    tight = told.where(at_edge).withColumn("_extra", (ahead + F.col("size") / 2 <= F.col("_rest")).cast("long"))
    return clear.unionByName(tight).withColumn("copies", F.least(F.col("_whole") + F.col("_extra"), F.lit(epochs)).cast("long"))


def mix(docs: DataFrame, seed: int = 17, epochs: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken, one row per input row."""
    sizes = written(_sized(docs, seed), "mixing")
    plan = written(_source_plan(sizes, epochs), "mixing-plan")
    rows = _copied(sizes, plan, epochs)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, seed: int = 17, epochs: int = 3) -> DataFrame:
    """The input's rows, each as often as `mix` takes it; texts are not shuffled but for those of one bin a source."""
    plan = written(_source_plan(written(_sized(docs, seed), "mixing"), epochs), "mixing-plan")
    rows = _copied(_sized(docs, seed, *docs.columns), plan, epochs).where("copies > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*(F.col(f"_in_{c}").alias(c) for c in docs.columns))


MIX_SQL = r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':17:' || md5(coalesce(text, ''))), 1, 13))::bigint as u
  from documents
), per_source as (
  select source, sum(size)::bigint as source_size from sizes group by source
), weighed as (
  select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight, 3 * source_size as cap from per_source
), stepped as (
  select *, coalesce(sum(cap) over (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
    sum(weight) over (order by cap::double / weight, source nulls last rows between current row and unbounded following) as open_weight,
    sum(source_size) over () as whole
  from weighed
), goal as (
  select source, source_size, least(cap::double, max((whole - before)::double / open_weight::double) over () * weight) as target from stepped
), parts as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as times from goal
), rests as (
  select *, target - times * source_size as rest from parts
), walked as (
  select doc_id, s.source, size, source_size, target, times, rest,
    coalesce(sum(size) over (partition by s.source order by u, doc_id, size rows between unbounded preceding and 1 preceding), 0) as ahead
  from sizes s join rests r on s.source is not distinct from r.source
), taken as (
  select *, least(times + (ahead + size::double / 2 <= rest)::int, 3)::bigint as copies from walked
)
select doc_id, source, size, source_size, target, copies, copies * size as taken from taken
"""
