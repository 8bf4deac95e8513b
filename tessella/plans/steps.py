"""A processing plan as a list of named steps over one table, all lazy until its result is used."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessella.sources.tables import Rule, load_rules

Step = Callable[..., DataFrame]
STEPS: dict[str, Step] = {}


def step(name: str) -> Callable[[Step], Step]:
    """Decorator: a function (table, **parameters) -> table becomes a step of that name."""

    def enter(fn: Step) -> Step:
        STEPS[name] = fn
        return fn

    return enter


@dataclass
class Plan:
    """Steps and their parameters, in order."""

    steps: list[tuple[str, dict]] = field(default_factory=list)

    def then(self, name: str, **parameters) -> Plan:
        if name not in STEPS:
            raise KeyError(f"no step {name}; there are {', '.join(sorted(STEPS))}")
        return Plan([*self.steps, (name, parameters)])

    def run(self, table: DataFrame) -> DataFrame:
        for name, parameters in self.steps:
            table = STEPS[name](table, **parameters)
        return table


def from_project(text: str) -> tuple[dict[str, str], Plan, list[Rule]]:
    """Inputs by channel, steps and association rules of a project's XML text.

    A step `<step name=".." key="value"/>` takes its attributes as parameters: those with commas as lists, and numbers as
    numbers; a query's text becomes an sql step.
    """

    def value(raw: str):
        if "," in raw:
            return [value(x.strip()) for x in raw.split(",")]
        try:
            return int(raw)
        except ValueError:
            return raw

    top = ElementTree.fromstring(text)
    inputs = {e.attrib.get("chname", e.attrib.get("type", e.tag)): (e.text or "").strip() for e in top.iter("file")}
    plan = Plan()
    for e in top.iter("step"):
        plan = plan.then(e.attrib["name"].lower(), **{k: value(v) for k, v in e.attrib.items() if k != "name"})
    for e in top.iter("SqlQuery"):
        plan = plan.then("sql", text=(e.text or "").strip())
    return inputs, plan, load_rules(text)


@step("zscore")
def _zscore(table: DataFrame, columns: list[str]) -> DataFrame:
    from tessella.operators.statistics import zscores

    return zscores(table, columns)


@step("exclude_margin")
def _margin(table: DataFrame, box: dict) -> DataFrame:
    from tessella.operators.filters import exclude_margin

    return exclude_margin(table, box)


@step("extract_class")
def _class(table: DataFrame, column: str, value: int, columns: list[str]) -> DataFrame:
    from tessella.operators.filters import of_class

    return of_class(table, column, value, *columns)


@step("group_means")
def _means(table: DataFrame, by: str, columns: list[str]) -> DataFrame:
    from tessella.operators.statistics import group_means

    return group_means(table, by, columns)


@step("sql")
def _sql(table: DataFrame, text: str, view: str = "objects", args: dict | None = None) -> DataFrame:
    return query(table.sparkSession, text, {view: table}, args)


def query(spark: SparkSession, text: str, views: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """SQL over named tables with bound parameters; nothing is pasted into the text."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args)
