"""A sieve for keys that occur often: counts are summed by key in a shuffle, and the keys that reach a least count set bits of
a bitmap of fixed size, which goes to all tasks. Every such key passes; of the others, about as many as bits are set. So a second
pass over the texts sends on little else, and later exact counts don't depend on the sieve's size. The bitmap has
`SLOTS` bits, 8 MB, whatever the input; that is the proven bound of what is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tessella.llm.stage import dropped, settled
from tessella.llm.textblock import mix

SLOTS = 1 << 26
#: Bits of one piece of the bitmap, made by one task.
PIECE = 1 << 18
#: Slots of one part of the sums that a task makes one by one.
PART = 1 << 12
#: Keys that a task holds before it sends their counts on.
FLUSH = 1 << 22


def counted(arrays: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows (k, c) of keys and their summed counts, summed within the task as far as memory allows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(np.add.reduceat(counts, first).astype(np.int64))], names=["k", "c"])

    for keys, counts in arrays:
        if len(keys):
            held.append((keys, counts))
            size += len(keys)
        if size > FLUSH:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def slots(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) % np.uint64(SLOTS)).astype(np.int64)


def often(counts: DataFrame, least: int) -> DataFrame:
    """The keys of (k, c) whose counts sum to `least` or more, with these sums."""
    return counts.groupBy("k").agg(F.sum("c").alias("c")).where(F.col("c") >= least)


def sieve(keys: DataFrame, free: bool = False) -> Broadcast:
    """The bitmap of the keys in column k; with `free`, its pieces are written first, so that their shuffles are deleted."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(slots(batch.column(0).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array((at // PIECE).astype(np.int32)), pa.array((at % PIECE).astype(np.int32))], names=["piece", "bit"])

    def pieces(table: pa.Table) -> pa.Table:
        bits = np.zeros(PIECE, np.uint8)
        bits[table["bit"].to_numpy()] = 1
        return pa.table({"piece": table["piece"].slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    made = keys.select("k").mapInArrow(placed, "piece int, bit int").distinct().groupBy("piece").applyInArrow(pieces, "piece int, bits binary")
    made = settled(made, "bits") if free else made
    whole = np.zeros(SLOTS // 8, np.uint8)
    for row in made.toLocalIterator():  # at most SLOTS / PIECE rows of PIECE / 8 bytes
        whole[row["piece"] * PIECE // 8 : (row["piece"] + 1) * PIECE // 8] = np.frombuffer(row["bits"], np.uint8)
    dropped(made)
    return keys.sparkSession.sparkContext.broadcast(whole)


def slotted(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (part, slots, counts) of how often keys fall into each slot, for a sieve without keys: a byte or two for each slot in use."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        at, count = np.unique(np.concatenate(held), return_counts=True)
        part, within = at // PART, (at % PART).astype(np.uint16)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        bounds = np.append(first, len(at)).astype(np.int32)
        # Gaps within a part, low bytes before high ones, which are mostly 0.
        gaps = np.diff(within, prepend=np.uint16(0))
        gaps[first] = within[first]
        packed = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((bounds * x.dtype.itemsize).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())]) for x in ((gaps & 0xFF).astype(np.uint8), (gaps >> 8).astype(np.uint8), count.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), *packed], names=["part", "low", "high", "counts"])

    for keys in arrays:
        if len(keys):
            held.append(slots(keys).astype(np.int32))
            size += len(keys)
        if size > FLUSH:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def slot_sieve(rows: DataFrame, least: int, free: bool = False) -> Broadcast:
    """The bitmap of the slots of `slotted` whose counts sum to `least` or more: all keys that occur so often pass. A task sums one part at a time, whatever the input. `free` as in `sieve`."""

    def closed(part: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = -1, np.zeros(PART)
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("part").to_numpy()
            low, high, counts = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in (("low", np.uint8), ("high", np.uint8), ("counts", np.uint32)))
            gaps = low.astype(np.int64) + (high.astype(np.int64) << 8)
            long = pc.binary_length(batch.column("low")).to_numpy().astype(np.int64)
            first = np.concatenate([[True], parts[1:] != parts[:-1]])
            # Where each slot lies among the slots of all parts of the batch.
            ends = np.cumsum(gaps)
            begin = np.cumsum(long) - long
            at = ends + np.repeat((np.cumsum(first) - 1) * PART - ends[begin] + gaps[begin], long)
            total = np.bincount(at, counts, minlength=int(first.sum()) * PART).reshape(-1, PART)
            names = parts[first].tolist()
            if names[0] == part:
                total[0] += sums
            elif part >= 0:
                yield closed(part, sums)
            for k in range(len(names) - 1):
                yield closed(names[k], total[k])
            part, sums = names[-1], total[-1]
        if part >= 0:
            yield closed(part, sums)

    made = rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, bits binary")
    made = settled(made, "bits") if free else made
    whole = np.zeros(SLOTS // 8, np.uint8)
    for row in made.toLocalIterator():  # at most SLOTS / PART rows of PART / 8 bytes
        whole[row["part"] * PART // 8 : (row["part"] + 1) * PART // 8] = np.frombuffer(row["bits"], np.uint8)
    dropped(made)
    return rows.sparkSession.sparkContext.broadcast(whole)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = slots(keys)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def salts(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each row its place among the distinct names (which come in no order), and a 64-bit number for each of these."""
    coded = names.dictionary_encode()
    told = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.array(told, np.uint64)
