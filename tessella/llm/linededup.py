"""Line dedup by a sharded minimal perfect hash (operator 11).

A line's key is the line stripped and lower-cased; keys of at least `least_chars` code points count. One pass over the
texts sums, by two 64-bit hashes of each key, the documents that hold it and the largest id among them. The distinct keys
of two documents or more go to shards by their hash. A shard builds a minimal perfect hash (levels of bits: a key takes the
first level where its bit is its own) and lays out three arrays in its order: fingerprints, counts and keepers. They
are some 20 bytes a key, whatever the lines.

A second pass asks the shards, which probe their arrays: a line goes if its fingerprint is there with a count of
at least `least_docs` and another document is the keeper. A task first settles what it can see by itself: of a key that it
has met in `least_docs` documents only its largest id has to ask, so that the commonest lines ask once a task. The answers
are joined to the documents by id and a hash of the text.

A null text is one empty line; `dedup` leaves it null. Rows are documents: repeated rows count each time. A null id is below
all others; among equal ids that are the largest, all keep the line, so ties cut nothing. A task holds a text whole, with some
30 bytes of memory for each byte of the longest. `dedup` returns extra columns, whatever their names; `digest` ignores them. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessella.llm.stage import written
from tessella.llm.textblock import BASE, LOWER, SPACE, Block, blocks, mix, spans_hash

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Keys of a shard, about; many more lines than that ask it.
SHARD_KEYS = 1 << 13
#: Bits that a level has for each key that it gets.
ROOM = 1.5
#: Pairs of a line and a document that a task holds before it sends them on.
FLUSH = 1 << 19
#: Stands for a null id.
NO_ID = -(1 << 63)
SECOND = 1 << 40


@dataclass
class PerfectHash:
    """A minimal perfect hash of pairs of 64-bit numbers: bits of all levels after another, and the size of each level."""

    sizes: np.ndarray
    bits: np.ndarray

    @staticmethod
    def _at(level: int, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            turn = np.uint64(level + 1) * BASE
        return (mix(a ^ mix(b + turn)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        """For distinct pairs."""
        sizes, levels = [], []
        while len(a):
            size = max(64, int(ROOM * len(a)))
            at = cls._at(len(sizes), a, b, size)
            bits = np.bincount(at, minlength=size) == 1
            left = ~bits[at]
            sizes.append(size)
            levels.append(bits)
            a, b = a[left], b[left]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool))

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places from 0 of the pairs that it was made of, all different; of others any place, or -1."""
        before = np.cumsum(self.bits) - self.bits
        out = np.full(len(a), -1, np.int64)
        open_, start = np.arange(len(a)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = start + self._at(level, a[open_], b[open_], size)
            hit = self.bits[at]
            out[open_[hit]] = before[at[hit]]
            open_, start = open_[~hit], start + size
        return out


def _keys(block: Block, least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places, among all lines of a block, of the lines whose key is long enough, and both hashes of these."""
    cuts, stops, _ = block.lines()
    dark = np.flatnonzero(~SPACE[block.data])
    low, high = np.searchsorted(dark, cuts), np.searchsorted(dark, stops)
    full = np.flatnonzero(high > low)
    starts, ends = dark[low[full]], dark[high[full] - 1] + 1
    chars = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=chars[1:])
    long = chars[ends] - chars[starts] >= least_chars
    data = LOWER[block.data]
    return full[long], spans_hash(data, starts[long], ends[long]), spans_hash(data, starts[long], ends[long], salt=SECOND)


def _change(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the row before it."""
    out = np.ones(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _held(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[tuple[np.ndarray, ...]]:
    """h1, h2, id and k of all pairs of a long key and a document, each once, sorted by h1, h2, id and k, for about `FLUSH` pairs at a time; rows are id, k and text."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = np.lexsort(columns[::-1])
        return tuple(c[order] for c in columns)

    for batch in batches:
        ids, k = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for block in blocks(batch.column(2)):
            at, h1, h2 = _keys(block, least_chars)
            if not len(at):
                continue
            text = block.lines()[2][at]
            order = np.lexsort((text, h2, h1))
            order = order[_change(h1[order], h2[order], text[order])]
            row = block.first + text[order]
            held.append((h1[order], h2[order], ids[row], k[row]))
            size += len(order)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _own(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("k"), text.alias("text"))


def _counts(own: DataFrame, least_chars: int) -> DataFrame:
    """h1, h2, n and keeper of every long key that two documents or more hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h1, h2, ids, _ in _held(batches, least_chars):
            first = np.flatnonzero(_change(h1, h2))
            columns = [h1[first].view(np.int64), h2[first].view(np.int64), np.diff(np.append(first, len(h1))), np.maximum.reduceat(ids, first)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "n", "keeper"])

    parts = own.mapInArrow(run, "h1 long, h2 long, n long, keeper long")
    return parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper")).where("n > 1")


def index(own: DataFrame, least_chars: int = LEAST_CHARS) -> tuple[DataFrame, int]:
    """A row for each shard - its perfect hash and its arrays - and the number of shards."""
    counts = written(_counts(own, least_chars), "lines")
    shards = max(1, counts.count() // SHARD_KEYS)

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        made = PerfectHash.of(h1, h2)
        order = np.argsort(made.places(h1, h2))
        arrays = [h2[order], np.minimum(table["n"].to_numpy()[order], 2**32 - 1).astype(np.uint32), table["keeper"].to_numpy()[order]]
        raw = [pa.array([x.tobytes()], pa.binary()) for x in (made.sizes, np.packbits(made.bits), *arrays)]
        return pa.table([table["shard"].slice(0, 1).combine_chunks(), *raw], names=["shard", "sizes", "bits", "fingerprints", "counts", "keepers"])

    sharded = counts.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return written(sharded.groupBy("shard").applyInArrow(build, "shard int, sizes binary, bits binary, fingerprints binary, counts binary, keepers binary"), "shards", counts), shards


def drops(own: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """id, k and hits: the hashes of the keys whose lines go, of each document that loses some."""
    if least_docs < 2:
        raise ValueError("a line of one document is kept there: least_docs is 2 or more")
    shard_rows, shards = index(own, least_chars)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h1, h2, ids, k in _held(batches, least_chars):
            first = _change(h1, h2)
            at = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            many = np.diff(np.append(at, len(h1)))[group]
            sure = (many >= least_docs) & (ids < np.maximum.reduceat(ids, at)[group])
            once = _change(h1, h2, ids, k)
            columns = [np.where(sure, k, h1.view(np.int64)), sure, h1.view(np.int64), h2.view(np.int64), ids, k]
            yield pa.RecordBatch.from_arrays([pa.array(c[once]) for c in columns], names=["to", "sure", "h1", "h2", "id", "k"])

    def answer(asked: pa.Table, arrays: pa.Table) -> pa.Table:
        gone = asked["sure"].to_numpy(zero_copy_only=False)
        if arrays.num_rows:
            raw = {c: arrays[c][0].as_buffer() for c in ("sizes", "bits", "fingerprints", "counts", "keepers")}
            sizes = np.frombuffer(raw["sizes"], np.int64)
            made = PerfectHash(sizes, np.unpackbits(np.frombuffer(raw["bits"], np.uint8), count=int(sizes.sum())).astype(bool))
            h1, h2 = (asked[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
            place = made.places(h1, h2)
            known = place >= 0
            known[known] = np.frombuffer(raw["fingerprints"], np.uint64)[place[known]] == h2[known]
            known[known] = np.frombuffer(raw["counts"], np.uint32)[place[known]] >= least_docs
            known[known] = np.frombuffer(raw["keepers"], np.int64)[place[known]] != asked["id"].to_numpy()[known]
            gone = gone | known
        return asked.select(["id", "k", "h1", "h2"]).filter(pa.array(gone))

    asked = own.mapInArrow(ask, "to long, sure boolean, h1 long, h2 long, id long, k long").withColumn("shard", F.pmod("to", F.lit(shards)).cast("int")).drop("to")
    told = asked.groupBy("shard").cogroup(shard_rows.groupBy("shard")).applyInArrow(answer, "id long, k long, h1 long, h2 long")
    return told.groupBy("id", "k").agg(F.collect_list(F.struct("h1", "h2")).alias("hits"))


def _cut(block: Block, least_chars: int, hit_text: np.ndarray, hits: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes and offsets of the texts without the lines that are hit, and each text's lines and dropped lines."""
    cuts, stops, text = block.lines()
    at, h1, h2 = _keys(block, least_chars)
    wanted = mix(hits[0] ^ mix(hit_text.astype(np.uint64) + BASE))
    order = np.argsort(wanted)
    own = mix(h1 ^ mix(text[at].astype(np.uint64) + BASE))
    gone = np.zeros(len(cuts), bool)
    if len(order):
        place = order[np.minimum(np.searchsorted(wanted[order], own), len(order) - 1)]
        gone[at] = (wanted[place] == own) & (hits[0][place] == h1) & (hits[1][place] == h2) & (hit_text[place] == text[at])
    first = _change(text)
    n_lines = np.bincount(text, minlength=len(block))
    n_gone = np.bincount(text[gone], minlength=len(block))
    if not gone.any():
        return block.data, block.offsets, n_lines, n_gone
    # A line's stretch of bytes begins with the newline before it; that of the first line that stays goes.
    keep = np.repeat(~gone, stops - cuts + ~first)
    stay = np.flatnonzero(~gone)
    lead = stay[_change(text[stay])]
    lead = lead[~first[lead]]
    keep[cuts[lead] - 1] = False
    total = np.concatenate([[0], np.cumsum(keep)])
    return block.data[keep], total[block.offsets], n_lines, n_gone


def _cut_rows(docs: DataFrame, row: Column, least_chars: int, least_docs: int) -> DataFrame:
    """row, kept, n_lines and n_dropped of each document; `row` is a column of `docs`."""
    gone = drops(_own(docs), least_chars, least_docs)
    text = F.col("text").cast("string")
    own = docs.select(row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("k"), text.alias("text"))
    joined = own.join(gone, ["id", "k"], "left").select("row", "text", F.col("hits.h1").alias("h1"), F.col("hits.h2").alias("h2"))
    field = next(f for f in joined.schema.fields if f.name == "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                part = batch.slice(block.first, len(block))
                many = pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy(zero_copy_only=False)
                hits = tuple(c.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in part.columns[2:])
                data, offsets, n_lines, n_gone = _cut(block, least_chars, np.repeat(np.arange(len(block)), many), hits)
                kept = pa.LargeStringArray.from_buffers(len(block), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), kept, pa.array(n_lines), pa.array(n_gone)], names=["row", "kept", "n_lines", "n_dropped"])

    return joined.mapInArrow(run, StructType([field, StructField("kept", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())]))


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The input's rows and columns, their texts without the lines that go."""
    cut = _cut_rows(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)), least_chars, least_docs)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    return cut.select(*((text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def digest(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each document."""
    cut = _cut_rows(docs, F.col("doc_id"), least_chars, least_docs)
    return cut.select(F.col("row").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


DIGEST_SQL = r"""
with docs as (
  select row_number() over () as row_id, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), lines as (
  select row_id, doc_id, unnest(lines) as line, unnest(range(len(lines))) as i from docs
), keys as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), common as (
  select key, max(doc_id) as keeper from keys where length(key) >= 40 group by key having count(distinct row_id) >= 5
), marked as (
  select k.*, c.key is not null and k.doc_id is distinct from c.keeper as gone from keys k left join common c on k.key = c.key
)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by row_id
"""
