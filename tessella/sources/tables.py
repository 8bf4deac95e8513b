"""Readers and writers of the text forms of object tables, traces and tracks."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tessella.functions.scalar import clean_header

SWC = StructType([StructField(n, t) for n, t in (("id", IntegerType()), ("type", IntegerType()), ("x", DoubleType()), ("y", DoubleType()), ("z", DoubleType()), ("r", DoubleType()), ("parent", IntegerType()))])


def _number(c, bad_as_zero: bool):
    value = F.expr(f"try_cast({c} as double)")
    return F.coalesce(value, F.lit(0.0)) if bad_as_zero else value


def load_table(spark: SparkSession, path: str, bad_as_zero: bool = False) -> DataFrame:
    """Whitespace-separated text with a header line; all columns double, text that is no number null (or 0).

    Only a file's first line with text is its header. Files of one path must have the same header.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    first = lines.groupBy("_file").agg(F.min_by(F.struct("_block", "_line", "value"), F.struct("_block", "_line")).alias("_head"))
    heads = [r["value"] for r in first.select("_head.value").distinct().limit(2).collect()]
    if len(heads) != 1:
        raise ValueError(f"{path} has {'files of different headers' if heads else 'no header'}")
    names = [clean_header(n) for n in heads[0].split()]
    body = lines.where(F.col("value") != heads[0]).select("value").unionByName(lines.where(F.col("value") == heads[0]).join(F.broadcast(first.select("_file", F.col("_head._line").alias("_first"))), "_file").where("_line <> _first").select("value"))  # one row a file
    parts = body.select(F.split(F.trim("value"), r"[ \t]+").alias("_p"))
    cells = parts.select(*(F.get("_p", F.lit(k)).alias(n) for k, n in enumerate(names)))
    return cells.select(*(_number(f"`{n}`", bad_as_zero).alias(n) for n in names))


def load_points(spark: SparkSession, path: str) -> DataFrame:
    """Headerless places x, y, z."""
    parts = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"[ \t,]+").alias("_p"))
    return parts.select(*(F.expr(f"try_cast(get(_p, {k}) as double)").alias(f"centroid_{c}") for k, c in enumerate("xyz")))


def load_rotated(spark: SparkSession, path: str) -> DataFrame:
    """One line per column: its name, then the values; repeated `#N/A` names get an ordinal."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("_line", F.monotonically_increasing_id())
    parts = lines.select("_line", F.split(F.trim("value"), r"[ \t]+").alias("_p")).select("_line", F.col("_p")[0].alias("name"), F.slice("_p", 2, F.size("_p")).alias("v"))
    order = Window.partitionBy("name").orderBy("_line")
    named = parts.withColumn("name", F.when(F.col("name") == "#N/A", F.concat("name", F.row_number().over(order).cast("string"))).otherwise(F.col("name")))
    names = [r["name"] for r in named.orderBy("_line").select("name").collect()]  # one a column of the table
    long = named.select("name", F.posexplode("v").alias("row", "value"))
    return long.groupBy("row").pivot("name", names).agg(F.first(F.expr("try_cast(value as double)"))).orderBy("row").drop("row")


def load_series(spark: SparkSession, index: str) -> DataFrame:
    """All tables that an XML index lists, with their place in it as `time`."""
    text = "\n".join(r["value"] for r in spark.read.text(index).collect())  # an index, not data
    files = [e.text.strip() for e in ElementTree.fromstring(text).iter("file")]
    out = None
    for t, path in enumerate(files):
        told = load_table(spark, path).withColumn("time", F.lit(t))
        out = told if out is None else out.unionByName(told, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"{index} lists no file")
    return out


def load_swc(spark: SparkSession, path: str) -> DataFrame:
    """Trace nodes; a parent of -1 marks a root."""
    return spark.read.csv(path, schema=SWC, sep=" ", comment="#", ignoreLeadingWhiteSpace=True)


def load_tracks(spark: SparkSession, path: str, kymograph: bool = False) -> DataFrame:
    """Rows `track t x y z`; a kymograph takes the time as z."""
    names = ("track", "t", "x", "y", "z")
    kinds = ("int", "int", "double", "double", "double")
    parts = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"[ \t]+").alias("_p"))
    rows = parts.select(*(F.expr(f"try_cast(get(_p, {k}) as {kind})").alias(n) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))))
    return rows.withColumn("z", F.col("t").cast("double")) if kymograph else rows


@dataclass(frozen=True)
class Rule:
    """An association rule: which values near an object to take, and how."""

    name: str
    target: str
    outside: int
    inside: int
    whole: bool
    mode: str


def load_rules(text: str) -> list[Rule]:
    """Rules of an XML text."""
    found = []
    for e in ElementTree.fromstring(text).iter():
        a = e.attrib
        if "Association_Type" in a:
            found.append(Rule(a.get("Name", ""), a.get("Target_Image", ""), int(a.get("Outside_Distance", 0)), int(a.get("Inside_Distance", 0)), a.get("Use_Whole_Object", "False") == "True", a["Association_Type"]))
    return found


def save_table(table: DataFrame, path: str, mode: str = "error") -> None:
    """Tab-separated text with a header; numbers as doubles."""
    numeric = [F.col(f.name).cast("double").alias(f.name) if f.dataType.simpleString() not in ("string", "boolean") else F.col(f.name) for f in table.schema.fields]
    table.select(*numeric).write.csv(path, sep="\t", header=True, mode=mode)


def save_table_append(table: DataFrame, path: str, number: int) -> None:
    """Append without a header, the first column replaced by a number."""
    first = table.columns[0]
    table.withColumn(first, F.lit(number)).write.csv(path, sep="\t", header=False, mode="append")


def save_series(table: DataFrame, path: str) -> None:
    """One folder per time step."""
    table.write.partitionBy("time").parquet(path)


def save_swc(nodes: DataFrame, path: str) -> None:
    """Nodes renumbered from 1, parents first, with their parents' new numbers."""
    from tessella.operators.graph import forest_depths

    placed = nodes.join(forest_depths(nodes.select("id", "parent")), "id")
    per_tree = placed.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("root")) - F.col("_n")  # one row a tree
    start = per_tree.select("root", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("root").orderBy("depth", "id"))
    numbered = placed.join(start, "root").withColumn("number", (F.col("_before") + rank).cast("int"))
    up = numbered.select(F.col("id").alias("parent"), F.col("number").alias("_up"))
    out = numbered.join(up, "parent", "left").select("number", "type", "x", "y", "z", "r", F.coalesce("_up", F.lit(-1)).alias("_parent"))
    out.write.csv(path, sep=" ", header=False)


def save_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.csv(f"{path}/nodes", header=True)
    edges.write.csv(f"{path}/edges", header=True)


def upsert_image(stored: DataFrame | None, rows: DataFrame, location: str) -> DataFrame:
    """The results table with one image's rows replaced: new columns appear with 0.0 for old rows, a known location keeps its number.

    A new location gets max(img_id) + 1.
    """
    if stored is None:
        return rows.withColumns({"img_id": F.lit(1).cast("long"), "img_location": F.lit(location)})
    known = stored.agg(F.max(F.when(F.col("img_location") == location, F.col("img_id"))).alias("own"), F.max("img_id").alias("top")).first()
    number = known["own"] if known["own"] is not None else (known["top"] or 0) + 1
    kept = stored.where(F.col("img_location") != location)
    fresh = rows.withColumns({"img_id": F.lit(number).cast("long"), "img_location": F.lit(location)})
    # Names are matched regardless of case, as in the store.
    names = {c.lower(): c for c in kept.columns}
    fresh = fresh.withColumnsRenamed({c: names[c.lower()] for c in fresh.columns if c.lower() in names and names[c.lower()] != c})
    return kept.unionByName(fresh, allowMissingColumns=True).na.fill(0.0)


def load_with_header(spark: SparkSession, header: str, data: str) -> DataFrame:
    """Whitespace-separated data whose column names stand in a file of their own."""
    names = [clean_header(n) for r in spark.read.text(header).collect() for n in r["value"].split()]  # a header, not data
    parts = spark.read.text(data).where(F.trim("value") != "").select(F.split(F.trim("value"), r"[ \t]+").alias("_p"))
    return parts.select(*(F.expr(f"try_cast(get(_p, {k}) as double)").alias(n) for k, n in enumerate(names)))


def load_cells(spark: SparkSession, path: str, dropped: tuple[str, ...] = ("Trace_File", "Distance_to_Device", "Soma_X", "Soma_Y", "Soma_Z")) -> DataFrame:
    """A feature table without the columns that are no features."""
    return load_table(spark, path).drop(*dropped)


def load_trace_xml(spark: SparkSession, path: str, row: str = "TraceLine") -> DataFrame:
    """line, its type and parent, and its points x, y, z in order, from XML with one element per line."""
    point = "struct<_ID:long,_X:double,_Y:double,_Z:double>"
    lines = spark.read.format("xml").option("rowTag", row).schema(f"_ID long, _Type long, _Parent long, TraceBit array<{point}>").load(path)
    bits = lines.select(F.col("_ID").alias("line"), F.col("_Type").alias("type"), F.coalesce("_Parent", F.lit(-1)).alias("parent_line"), F.posexplode("TraceBit").alias("position", "_b"))
    return bits.select("line", "type", "parent_line", "position", F.col("_b._ID").alias("id"), *(F.col(f"_b._{c.upper()}").alias(c) for c in "xyz"))


def load_database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database that the session has a driver for."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def load_raw_volumes(spark: SparkSession, path: str, shape: tuple[int, int, int], kind: str = "uint8") -> DataFrame:
    """file, z, y, x and value of raw image volumes of a known shape (z, y, x), little endian; each file is one row on the way."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(content.as_py(), np.dtype(kind).newbyteorder("<")).reshape(shape)
                for z in range(shape[0]):
                    y, x = (a.reshape(-1) for a in np.indices(shape[1:]))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.full(len(x), z, np.int32)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(values[z].reshape(-1).astype(np.float64))], names=["file", "z", "y", "x", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, z int, y int, x int, value double")


def rules_xml(rules: list[Rule]) -> str:
    """Rules as XML text, as `load_rules` reads it."""
    top = ElementTree.Element("ObjectAssociationRules")
    for r in rules:
        ElementTree.SubElement(top, "AssociationRule", {"Name": r.name, "Target_Image": r.target, "Outside_Distance": str(r.outside), "Inside_Distance": str(r.inside), "Use_Whole_Object": str(r.whole), "Association_Type": r.mode})
    return ElementTree.tostring(top, encoding="unicode")


def save_query(spark: SparkSession, text: str, path: str, args: dict | None = None) -> None:
    """The rows of a query as text with a header."""
    spark.sql(text, args=args).write.csv(path, header=True)


def save_clustering(mergers: DataFrame, members: DataFrame, path: str) -> None:
    """Mergers and members as one text table each."""
    mergers.write.csv(f"{path}/mergers", header=True)
    members.write.csv(f"{path}/members", header=True)


def save_ids(table: DataFrame, path: str, key: str = "id") -> None:
    """The keys of selected rows, one a line."""
    table.select(F.col(key).cast("string")).write.text(path)


def save_by_class(voxels: DataFrame, classes: DataFrame, path: str) -> None:
    """Object voxels in one folder per class of their labels (label, class)."""
    voxels.where("label <> 0").join(classes.select("label", "class"), "label").write.partitionBy("class").parquet(path)


def save_selected_features(table: DataFrame, features: list[str], path: str, key: str = "id") -> None:
    """z-scores of the selected features as a text table, and their names, one a line."""
    from tessella.operators.statistics import zscores

    save_table(zscores(table.select(key, *features), features), f"{path}/table")
    table.sparkSession.createDataFrame([(f,) for f in features], "value string").coalesce(1).write.text(f"{path}/names")


def save_track_features(rows: DataFrame, path: str) -> None:
    """The summary of every track as a text table."""
    from tessella.operators.tracks import summary

    save_table(summary(rows), path)


def load_vtk_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, position, id, x, y and z of a legacy text polydata file's lines; point ids count from 0."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?s)POINTS\s+\d+\s+\w+\s+(.*?)LINES", 1).alias("p"), F.regexp_extract("value", r"(?s)LINES\s+\d+\s+\d+\s+([\d\s]+)", 1).alias("l"))
    number = text.select(F.posexplode(F.split(F.trim(F.regexp_replace("p", r"\s+", " ")), " ")).alias("k", "v"))
    places = number.groupBy(F.floor(F.col("k") / 3).alias("id")).agg(*(F.max(F.when(F.col("k") % 3 == j, F.col("v").cast("double"))).alias(c) for j, c in enumerate("xyz")))
    rows = text.select(F.explode(F.split(F.trim("l"), r"\s*\n\s*")).alias("row")).withColumn("line", F.monotonically_increasing_id())
    bits = rows.select("line", F.posexplode(F.split(F.trim("row"), r"\s+")).alias("position", "v")).where("position > 0")
    return bits.select("line", (F.col("position") - 1).alias("position"), F.col("v").cast("long").alias("id")).join(places, "id").select("line", "position", "id", "x", "y", "z")

