"""Series of image volumes as a Spark data source: raw slabs, described by XML files, one row a voxel (t, ch, z, y, x, value).

A series file lists one XML file for each time, which lists the raw files of its channels with their types and sizes:

    <Image><file>time_0.xml</file> ..</Image>
    <Image><file chname="0" type="uint16" z="0" depth="16" height="512" width="512">ch_0_z_0.raw</file> ..</Image>

Paths are relative to the file that names them. Numbers are little-endian, x runs fastest. A channel may lie in several files, each a slab of planes.
The reader makes one partition for each slab of at most `slab_bytes`, which reads its byte range only; filters on t, ch and z
leave slabs out before anything is read. The writer gives every task its own files, and the XML files are written when all tasks have
succeeded, the series file last: a reader sees all of a series or none.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tessella.sources.shared import kept_until_end

SCHEMA = "t int, ch int, z int, y int, x int, value double"
TYPES = ("uint8", "uint16", "uint32", "int16", "int32", "float32", "float64")
SLAB_BYTES = 16 << 20


@dataclass
class Slab(InputPartition):
    path: str
    t: int
    ch: int
    z: int
    depth: int
    height: int
    width: int
    type: str
    offset: int

    @property
    def plane_bytes(self) -> int:
        return self.height * self.width * np.dtype(self.type).itemsize


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _xml(path: str) -> ElementTree.Element:
    system, inner = _opened(path)
    with system.open_input_stream(inner) as f:
        root = ElementTree.fromstring(f.read())
    if root.tag != "Image":
        raise ValueError(f"{path} describes no image: its root is {root.tag}")
    return root


def _beside(path: str, name: str) -> str:
    return name if "://" in name or name.startswith("/") else posixpath.join(posixpath.dirname(path), name)


def slabs(path: str, slab_bytes: int = SLAB_BYTES) -> list[Slab]:
    """What a series file, or one time's file, names, cut into slabs of whole planes."""
    root = _xml(path)
    times = [path] if any("type" in f.attrib for f in root.iter("file")) else [_beside(path, f.text.strip()) for f in root.iter("file")]
    out = []
    for t, one in enumerate(times):
        for f in (root if one == path else _xml(one)).iter("file"):
            if f.get("type") not in TYPES:
                raise ValueError(f"{one}: type {f.get('type')} is none of {', '.join(TYPES)}")
            first, depth, height, width = (int(f.get(k, 0)) for k in ("z", "depth", "height", "width"))
            whole = Slab(_beside(one, f.text.strip()), int(f.get("t", t)), int(f.get("chname")), first, depth, height, width, f.get("type"), 0)
            planes = max(1, slab_bytes // max(1, whole.plane_bytes))
            out += [Slab(whole.path, whole.t, whole.ch, first + z, min(planes, depth - z), height, width, whole.type, z * whole.plane_bytes) for z in range(0, depth, planes)]
    return out


def _keeps(filter: Filter, slab: Slab) -> bool | None:
    """Whether a slab can hold rows that pass; None if this filter isn't about slabs."""
    name = filter.attribute[0] if getattr(filter, "attribute", None) else None
    if name not in ("t", "ch", "z"):
        return None
    low, high = (slab.z, slab.z + slab.depth - 1) if name == "z" else (getattr(slab, name),) * 2
    if isinstance(filter, In):
        return any(low <= v <= high for v in filter.value)
    tests = {EqualTo: lambda v: low <= v <= high, GreaterThan: lambda v: high > v, GreaterThanOrEqual: lambda v: high >= v, LessThan: lambda v: low < v, LessThanOrEqual: lambda v: low <= v}
    return tests[type(filter)](filter.value) if type(filter) in tests else None


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.filters = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.filters.append(f)
            # Spark filters rows again: a slab holds more planes than asked for.
            yield f

    def partitions(self) -> list[InputPartition]:
        found = slabs(self.options["path"], int(self.options.get("slab_bytes", SLAB_BYTES)))
        return [s for s in found if all(_keeps(f, s) is not False for f in self.filters)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no slab is left
            return
        p = partition
        system, inner = _opened(p.path)
        y, x = (a.ravel().astype(np.int32) for a in np.indices((p.height, p.width)))
        with system.open_input_file(inner) as f:
            for k in range(p.depth):
                raw = f.read_at(p.plane_bytes, p.offset + k * p.plane_bytes)
                if len(raw) != p.plane_bytes:
                    raise ValueError(f"{p.path} ends before plane {p.z + k}")
                value = np.frombuffer(raw, np.dtype(p.type).newbyteorder("<")).astype(np.float64)
                same = (np.full(len(value), v, np.int32) for v in (p.t, p.ch, p.z + k))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*same, y, x, value)], names=["t", "ch", "z", "y", "x", "value"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, int, int, int, str]]  # t, ch, z, depth and name


class VolumeWriter(DataSourceArrowWriter):
    """Rows come grouped by (t, ch, slab) and sorted (`write` sees to that); places without a row become 0."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.type = options["path"], options.get("type", "uint16")
        self.height, self.width, self.planes = (int(options[k]) for k in ("height", "width", "planes"))
        if self.type not in TYPES:
            raise ValueError(f"type {self.type} is none of {', '.join(TYPES)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inner = _opened(self.folder)
        system.create_dir(inner, recursive=True)
        made: list[tuple[int, int, int, int, str]] = []
        key, slab = None, None

        def close() -> None:
            if key is None:
                return
            depth = int(np.flatnonzero(slab[1]).max()) + 1
            name = f"t_{key[0]}_ch_{key[1]}_z_{key[2] * self.planes}_{uuid.uuid4().hex[:8]}.raw"
            with system.open_output_stream(f"{inner}/{name}") as f:
                f.write(slab[0][:depth].astype(np.dtype(self.type).newbyteorder("<")).tobytes())
            made.append((key[0], key[1], key[2] * self.planes, depth, name))

        for batch in iterator:
            t, ch, z, y, x, value = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("t", "ch", "z", "y", "x", "value"))
            if self.type[0] != "f" and len(value) and (np.isnan(value).any() or value.min() < np.iinfo(self.type).min or value.max() > np.iinfo(self.type).max or (value % 1).any()):
                raise ValueError(f"a value does not fit type {self.type}")
            part = z // self.planes
            edges = np.flatnonzero((t[1:] != t[:-1]) | (ch[1:] != ch[:-1]) | (part[1:] != part[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(t)], strict=True):
                if a == b:
                    continue
                if key != (here := (int(t[a]), int(ch[a]), int(part[a]))):
                    close()
                    key, slab = here, (np.zeros((self.planes, self.height, self.width)), np.zeros(self.planes, bool))
                level = z[a:b] - part[a] * self.planes
                slab[0][level, y[a:b], x[a:b]] = value[a:b]
                slab[1][level] = True
        close()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted(f for m in messages if m is not None for f in m.files)
        system, inner = _opened(self.folder)
        series = ElementTree.Element("Image")
        for t in sorted({f[0] for f in files}):
            time = ElementTree.Element("Image")
            for _, ch, z, depth, name in (f for f in files if f[0] == t):
                told = {"t": t, "chname": ch, "r": 255, "g": 255, "b": 255, "type": self.type, "z": z, "depth": depth, "height": self.height, "width": self.width}
                ElementTree.SubElement(time, "file", {k: str(v) for k, v in told.items()}).text = name
            self._save(system, f"{inner}/time_{t}.xml", time)
            ElementTree.SubElement(series, "file").text = f"time_{t}.xml"
        self._save(system, f"{inner}/series.xml", series)

    @staticmethod
    def _save(system: fs.FileSystem, path: str, root: ElementTree.Element) -> None:
        with system.open_output_stream(path) as f:
            f.write(ElementTree.tostring(root))

    def abort(self, messages: list[Written | None]) -> None:
        system, inner = _opened(self.folder)
        for m in messages:
            for *_, name in m.files if m is not None else []:
                system.delete_file(f"{inner}/{name}")


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(dict(self.options))


def read(spark: SparkSession, path: str, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """The voxels of a series file, or of one time's file."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeSource)
    return spark.read.format("volume").option("path", path).option("slab_bytes", slab_bytes).load()


def write(voxels: DataFrame, folder: str, type: str = "uint16", slab_bytes: int = SLAB_BYTES) -> str:
    """Write voxels (t, ch, z, y, x, value), places from 0, as a series; returns the path of its series file. A task holds one slab at a time."""
    spark = voxels.sparkSession
    spark.dataSource.register(VolumeSource)
    most = voxels.agg(F.max("y").alias("y"), F.max("x").alias("x"), F.min(F.least("z", "y", "x")).alias("least")).first()
    if most["y"] is not None and most["least"] < 0:
        raise ValueError("places begin at 0")
    height, width = (int(most["y"]) + 1, int(most["x"]) + 1) if most["y"] is not None else (1, 1)
    planes = max(1, slab_bytes // (8 * height * width))
    own = voxels.select(*(F.col(c).cast("int").alias(c) for c in ("t", "ch", "z", "y", "x")), F.col("value").cast("double").alias("value"))
    slab = F.floor(F.col("z") / planes)
    dealt = own.repartition("t", "ch", slab).sortWithinPartitions("t", "ch", slab)
    dealt.write.format("volume").mode("append").options(path=folder, type=type, height=height, width=width, planes=planes).save()
    return f"{folder}/series.xml"


def written_volume(voxels: DataFrame, type: str = "uint16", slab_bytes: int = SLAB_BYTES) -> str:
    """`write` to a folder of the session's shared one, deleted when the application ends."""
    return write(voxels, kept_until_end(voxels.sparkSession, "volume"), type, slab_bytes)
