"""Row and column selection over object tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Range:
    """A closed range predicate on a column, or its complement."""

    column: str
    low: float
    high: float
    inside: bool = True

    def test(self) -> Column:
        c = F.col(self.column)
        return c.between(self.low, self.high) if self.inside else (c < self.low) | (c > self.high)


def combine(ranges: list[Range], operators: list[str]) -> Column:
    """Predicates joined strictly from left to right: `a AND b OR c` is `(a AND b) OR c`, `a OR b AND c` is `(a OR b) AND c`."""
    if len(operators) != len(ranges) - 1:
        raise ValueError("one operator fewer than predicates")
    found = ranges[0].test()
    for op, r in zip(operators, ranges[1:], strict=True):
        found = (found & r.test()) if op.upper() == "AND" else (found | r.test())
    return found


def select_ids(table: DataFrame, key: str, ranges: list[Range], operators: list[str]) -> DataFrame:
    """Ids of the rows that pass."""
    return table.where(combine(ranges, operators)).select(key)


def bounds(table: DataFrame, column: str) -> DataFrame:
    return table.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def columns_with(table: DataFrame, part: str) -> list[str]:
    return [c for c in table.columns if part in c]


def extract(table: DataFrame, columns: list[str], always: str | None = None) -> DataFrame:
    """Chosen columns, and once each every column whose name contains `always`."""
    return table.select(*dict.fromkeys([*columns, *(columns_with(table, always) if always else [])]))


def exclude_margin(table: DataFrame, box: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows whose coordinates all lie in closed ranges."""
    return table.where(reduce(lambda a, b: a & b, (F.col(c).between(lo, hi) for c, (lo, hi) in box.items())))


def of_class(table: DataFrame, column: str, value: int, *columns: str) -> DataFrame:
    return table.where(F.col(column) == value).select(*columns)


def keep_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_semi")


def drop_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def set_where(table: DataFrame, column: str, ids: DataFrame, key: str, value: object) -> DataFrame:
    """`column` becomes `value` for the given ids."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    joined = table.join(hit, key, "left")
    new = F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(column)) if column in table.columns else F.when(F.col("_hit"), F.lit(value))
    return joined.withColumn(column, new).drop("_hit").select(*dict.fromkeys([*table.columns, column]))


def with_blank_row(table: DataFrame, key: str) -> DataFrame:
    """One more row under the next id, all else null."""
    row = table.agg((F.coalesce(F.max(key), F.lit(0)) + 1).cast(table.schema[key].dataType).alias(key))
    return table.unionByName(row, allowMissingColumns=True)


def merge_ids(table: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Ids replaced by their groups' ids (columns `key`, `into`); others stay."""
    return table.join(groups.select(key, "into"), key, "left").withColumn(key, F.coalesce("into", key)).drop("into").select(*table.columns)


def without_zero_columns(table: DataFrame, columns: list[str]) -> DataFrame:
    """Drop columns that are zero or null in every row; one pass finds them."""
    used = table.agg(*(F.max((F.coalesce(F.col(c), F.lit(0)) != 0).cast("int")).alias(c) for c in columns)).first()
    return table.drop(*(c for c in columns if not used[c]))


def mask_attribute(table: DataFrame, mask: DataFrame, x: str, y: str, value: str, name: str = "roi") -> DataFrame:
    """Attribute of a raster table (x, y, value) at each row's rounded place; 0 outside."""
    cells = mask.select(F.col(x).cast("long").alias("_x"), F.col(y).cast("long").alias("_y"), F.col(value).alias(name))
    placed = table.join(cells, (F.floor(x) == F.col("_x")) & (F.floor(y) == F.col("_y")), "left")
    return placed.withColumn(name, F.coalesce(name, F.lit(0))).drop("_x", "_y")


def sorted_rows(table: DataFrame, column: str, *ties: str) -> DataFrame:
    """Rows in rising order of a column, nulls last, ties by further columns; a range shuffle, no single task."""
    return table.orderBy(F.col(column).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ties))
