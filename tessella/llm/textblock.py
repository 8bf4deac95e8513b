"""Vectorised work on the UTF-8 bytes of many texts at once.

A block holds the bytes of consecutive texts of an Arrow column. Words are maximal runs of bytes
outside 0x20 and 0x09-0x0D; they never cross texts. Hashes of words and lines sum scattered values of
bytes at their places; hashes of windows, which are short, are 64-bit polynomials.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
SEGMENT_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((BASE, BASE_INVERSE)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Block:
    first: int  # row of the first text in its column
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than texts

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def prefix_hash(self, data: np.ndarray | None = None) -> np.ndarray:
        """Running sums from which `span_hash` takes the hash of any span."""
        data = self.data if data is None else data
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * powers(max(len(data), 1))[0][: len(data)], out=total[1:])
        return total

    def words(self, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each text the index of its first word (one more at the end); `apart` holds for bytes outside words."""
        dark = ~apart[self.data]
        first, last = dark.copy(), dark.copy()
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(dark))]
        if len(dark) > 1:
            first[1:] &= ~dark[:-1]
            last[:-1] &= ~dark[1:]
        first[cuts] = dark[cuts]
        last[cuts - 1] = dark[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all lines, newlines left out, and the text of each; an empty text has one empty line."""
        newline = np.flatnonzero(self.data == 0x0A)
        cuts = np.concatenate([self.offsets[:-1], newline + 1])
        stops = np.concatenate([newline, self.offsets[1:]])
        cuts.sort()
        stops.sort()
        many = np.diff(np.searchsorted(newline, self.offsets)) + 1
        return cuts, stops, np.repeat(np.arange(len(self)), many)


def span_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of the data behind `total`; equal bytes give equal hashes."""
    inverse = powers(max(len(total), 1))[1]
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _placed(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A value for each byte at its place in a span. Unlike terms of a polynomial they have no common factor, so that no pattern of letters cancels out."""
    h = BYTE_VALUE[data] + place.astype(np.uint64) * BASE
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = SEGMENT_BYTES, salt: int = 0) -> np.ndarray:
    """Hashes of spans in order that don't overlap, from running sums over `limit` bytes at a time, so that memory follows the spans; equal bytes give equal hashes, and each `salt` hashes of their own."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        a = int(starts[at])
        stop = int(np.searchsorted(ends, a + limit, "right"))
        if stop > at:
            own, b = starts[at:stop], int(ends[stop - 1])
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_placed(data[a:b], np.arange(a + salt, b + salt) - np.repeat(own, np.diff(np.append(own, b)))), out=total[1:])
            out[at:stop] = total[ends[at:stop] - a] - total[own - a]
            at = stop
            continue
        # One span of more than the limit: the sum of its parts.
        b = int(ends[at])
        sums = [_placed(data[c : min(c + limit, b)], np.arange(c - a + salt, min(c + limit, b) - a + salt)).sum(dtype=np.uint64) for c in range(a, b, limit)]
        out[at] = np.array(sums, np.uint64).sum(dtype=np.uint64)
        at += 1
    return mix(out + (ends - starts).astype(np.uint64))


def window_hash(parts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` consecutive values."""
    n = len(parts) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = parts[:n].copy()
    for k in range(1, width):
        out *= BASE
        out += parts[k : n + k]
    return mix(out)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole texts of about `limit` bytes; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, values = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield Block(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of whole rows with about `limit` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    at = 0
    for stop in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
        if stop > at:
            yield batch.slice(at, stop - at)
        at = stop


def gathered(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in turn, in batches of whole rows with about `limit` bytes of text each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in (p for batch in batches for p in slices(batch, column, limit)):
        own = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
        if held and size + own > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield pa.concat_batches(held)


def counts_by_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of `flags` between consecutive bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
