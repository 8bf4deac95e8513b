"""Column statistics, histograms, per-cluster aggregates and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def column_statistics(table: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: n, mean, sample sd, min, max, exact median, and mode (null if nothing repeats; ties to the smallest)."""
    long = table.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("double") for c in columns)))).alias("name", "value")).where("value is not null")
    counts = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("c"))
    mode = counts.groupBy("name").agg(F.max(F.struct("c", (-F.col("value")).alias("v"))).alias("_m"))
    mode = mode.select(F.col("name").alias("_n"), F.when(F.col("_m.c") > 1, -F.col("_m.v")).alias("mode"))
    main = long.groupBy("name").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"), F.median("value").alias("median"))
    return main.join(mode, F.col("name") == F.col("_n")).drop("_n")


def histogram(table: DataFrame, column: str, bins: int = 10, subset: Column | None = None) -> DataFrame:
    """Counts in equal-width bins over the column's range, the last bin closed; the bins are those of all rows, the counts those of the subset."""
    edge = table.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    rows = (table.where(subset) if subset is not None else table).where(F.col(column).isNotNull()).crossJoin(F.broadcast(edge))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_of = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return rows.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def log_counts(counts: DataFrame, base: float = 10.0) -> DataFrame:
    return counts.withColumn("log_n", F.when(F.col("n") > 1, F.log(float(base), F.col("n"))).otherwise(F.col("n").cast("double")))


def equal_count_bins(table: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows with the bin between approximate quantiles; no global sort."""
    cuts = table.approxQuantile(column, [k / bins for k in range(1, bins)], 0.001)
    return table.withColumn("bin", sum((F.col(column) > F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0))


def group_means(table: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return table.groupBy(by).agg(*(F.avg(c).alias(c) for c in columns))


def anova(table: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Intraclass correlation (MSB - MSW) / (MSB + (k - 1) MSW) of each column, k the mean group size."""
    long = table.select(F.col(group).alias("g"), F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("double") for c in columns)))).alias("name", "v")).where("v is not null")
    per = long.groupBy("name", "g").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    tot = per.groupBy("name").agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("G"), F.sum("s").alias("S"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"), F.sum("q").alias("Q"))
    msb = (F.col("B") - F.col("S") * F.col("S") / F.col("N")) / (F.col("G") - 1)
    msw = (F.col("Q") - F.col("B")) / (F.col("N") - F.col("G"))
    k = F.col("N") / F.col("G")
    return tot.select("name", msb.alias("msb"), msw.alias("msw")).withColumn("k", F.lit(0.0)).drop("k").join(tot.select(F.col("name").alias("_n"), k.alias("k")), F.col("name") == F.col("_n")).select("name", "msb", "msw", ((F.col("msb") - F.col("msw")) / (F.col("msb") + (F.col("k") - 1) * F.col("msw"))).alias("icc"))


def share_within(table: DataFrame, by: str, column: str, threshold: float) -> DataFrame:
    return table.groupBy(by).agg(F.avg((F.col(column) <= threshold).cast("double")).alias("share"))


def zscores(table: DataFrame, columns: list[str]) -> DataFrame:
    """(v - mean) / sample sd; a constant column stays as it is. One pass gathers the moments of all columns."""
    moments = table.agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))))
    both = table.crossJoin(F.broadcast(moments))  # one row
    return both.withColumns({c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.col(c).cast("double")) for c in columns}).select(*table.columns)


def minmax(table: DataFrame, columns: list[str], low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Linear scaling of each column's range to [low, high]; a constant column becomes low."""
    ends = table.agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("a", F.min), ("b", F.max))))
    both = table.crossJoin(F.broadcast(ends))  # one row
    scaled = {c: F.when(F.col(f"_b_{c}") > F.col(f"_a_{c}"), low + (high - low) * (F.col(c) - F.col(f"_a_{c}")) / (F.col(f"_b_{c}") - F.col(f"_a_{c}"))).otherwise(F.lit(low)) for c in columns}
    return both.withColumns(scaled).select(*table.columns)


def top_features(weights: DataFrame, k: int = 5) -> DataFrame:
    """The k features of the largest absolute weight over all classes, from rows (feature, weight)."""
    best = weights.groupBy("feature").agg(F.max(F.abs("weight")).alias("weight"))
    return best.orderBy(F.col("weight").desc(), "feature").limit(k)


def emd(table: DataFrame, value: str, side: str, bins: int = 20) -> DataFrame:
    """Earth mover's distance, in bins, between the histograms of the two values of `side`: the sum of the differences of their running shares."""
    edge = table.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    rows = table.crossJoin(F.broadcast(edge))  # one row
    bin_of = F.least(F.floor((F.col(value) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1)).cast("int")
    per = rows.groupBy(bin_of.alias("bin")).agg(F.sum((~F.col(side)).cast("double")).alias("a"), F.sum(F.col(side).cast("double")).alias("b"))
    whole = Window.partitionBy()
    run = Window.orderBy("bin")  # one row a bin
    shares = per.select("bin", (F.sum("a").over(run) / F.sum("a").over(whole) - F.sum("b").over(run) / F.sum("b").over(whole)).alias("d"))
    return shares.agg(F.sum(F.abs("d")).alias("emd"))


def approximate_share_lookup(table: DataFrame, column: str, threshold: float) -> DataFrame:
    """Share of rows at or above a positive threshold."""
    return table.agg(F.avg(((F.col(column) >= threshold) & (F.col(column) > 0)).cast("double")).alias("share"))


def share_threshold(table: DataFrame, column: str, share: float) -> DataFrame:
    """The value that the given share of the positive rows reaches or exceeds."""
    return table.where(F.col(column) > 0).agg(F.percentile(column, F.lit(1.0 - share)).alias("threshold"))


def interval_histogram(table: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Counts between given rising edges, each bin closed below and the last one above too; rows outside are left out."""
    place = sum((F.col(column) >= e).cast("int") for e in edges) - 1
    last = len(edges) - 2
    binned = table.where(F.col(column).between(edges[0], edges[-1])).select(F.least(place, F.lit(last)).alias("bin"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def correlations(table: DataFrame, columns: list[str]) -> DataFrame:
    """feature_1, feature_2 and Pearson's r of every pair of columns, from one aggregation."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    row = table.agg(*(F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    told = F.array(*(F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))
    return row.select(F.explode(told).alias("_p")).select("_p.*")


def feature_modules(table: DataFrame, columns: list[str], least: float = 0.7) -> DataFrame:
    """feature and module: the two modules whose mean scaled features correlate most are joined until none reaches `least`.

    A module's mean has covariances that are sums over its members' correlations, so the table is read once.
    """
    found = {(r["feature_1"], r["feature_2"]): r["r"] or 0.0 for r in correlations(table, columns).collect()}  # one row a pair of columns
    r = lambda a, b: 1.0 if a == b else found.get((a, b), found.get((b, a), 0.0))
    modules = [[c] for c in columns]
    inner = lambda p, q: sum(r(a, b) for a in p for b in q)
    while len(modules) > 1:
        score = lambda i, j: inner(modules[i], modules[j]) / max(1e-12, (inner(modules[i], modules[i]) * inner(modules[j], modules[j])) ** 0.5)
        best, i, j = max((score(i, j), i, j) for i in range(len(modules)) for j in range(i + 1, len(modules)))
        if best < least:
            break
        modules[i] = modules[i] + modules.pop(j)
    return table.sparkSession.createDataFrame([(c, k) for k, m in enumerate(modules) for c in m], "feature string, module int")


def module_means(table: DataFrame, key: str, modules: dict[str, list[str]]) -> DataFrame:
    """Key and, for each module of columns, the mean of their z-scores."""
    columns = sorted({c for m in modules.values() for c in m})
    scaled = zscores(table.select(key, *(F.col(c).cast("double").alias(c) for c in columns)), columns)
    return scaled.select(key, *((sum(F.col(c) for c in m) / len(m)).alias(name) for name, m in modules.items()))


def group_order(table: DataFrame, by: str, column: str) -> DataFrame:
    """Groups with their size, mean, and rank by the mean, ties by name; the window runs over one row a group."""
    per = table.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy("mean", by)))


def average_histogram(table: DataFrame, column: str, by: str, bins: int = 10) -> DataFrame:
    """Mean over groups of each group's share of rows in every bin, the bins being those of all rows."""
    edge = table.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    rows = table.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edge))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_of = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = rows.groupBy(F.col(by).alias("g"), bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    whole = counts.groupBy("g").agg(F.sum("c").alias("n"))
    groups = whole.agg(F.count(F.lit(1)).alias("k"))
    shares = counts.join(whole, "g").groupBy("bin").agg(F.sum(F.col("c") / F.col("n")).alias("s"))
    return shares.crossJoin(F.broadcast(groups)).select("bin", (F.col("s") / F.col("k")).alias("share"))  # one row
