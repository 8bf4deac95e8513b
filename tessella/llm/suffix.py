"""Exact removal of repeated strings with a two-stage suffix array (operator 1).

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the corpus.

1. Every window of `length` bytes belongs to the smallest hash among its `gram`-byte substrings (the first
   such, if several). Equal windows have equal hashes, so they meet in one group. Consecutive windows with
   the same smallest substring form a piece: one row with the group, a hash of the piece's bytes, and its place.
2. Groups of one piece hold nothing repeated. Pieces with equal bytes are collapsed: all their windows repeat.
3. The bytes of what is left - different pieces of one group - are fetched. Windows whose hash no other has can't
   repeat; the rest is sorted by suffix. Suffixes smaller than their successors are sorted directly, all others
   follow by scans over the buckets of first bytes. Adjacent suffixes with a common prefix of `length` bytes or
   more repeat.
4. A group of more than `group_limit` different pieces is not sorted in one task: its windows are dealt out
   singly by hash and counted. No string is lost either way.

Texts are whole UTF-8 texts; a null is empty. Texts shorter than `length` keep everything. Repeated rows
count as different places, so copies remove each other; rows with equal doc_id and text come back once each
with the same result. A null doc_id is a document like any other. Ties don't arise: every occurrence of a
repeated string goes. A task holds a text whole as bytes; all work on it is in parts of bounded size.
`cut` returns extra columns, whatever their names; `digest` ignores them. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.stage import written
from tessella.llm.textblock import Block, blocks, span_hash

LENGTH = 400
GRAM = 100
GROUP_LIMIT = 4096
CHUNK_BYTES = 1 << 20
PART_BYTES = 1 << 22


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over every run of `width` values."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return pick(x[:-rest], x[rest:]) if rest else x


def pieces_of(block: Block, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Group, piece hash, text, start in the text, and number of windows of every piece of a block."""
    data, offsets = block.data, block.offsets
    n = len(data)
    none = np.zeros(0, np.int64)
    long_enough = np.flatnonzero(np.diff(offsets) >= length)
    if not len(long_enough):
        return (none.view(np.uint64), none.view(np.uint64), none, none, none)
    width = length - gram + 1
    total = block.prefix_hash()
    at = np.arange(n - gram + 1)
    hashes = span_hash(total, at, at + gram)
    least = _slide(hashes, width, np.minimum)  # of the window that starts here
    pad = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(hashes == _slide(np.concatenate([pad, least, pad]), width, np.maximum))
    # Where one smallest value occurs twice in a window, the first counts: a piece ends where it leaves the window.
    tie = (hashes[chosen[1:]] == hashes[chosen[:-1]]) & (np.diff(chosen) <= width)
    first, last = offsets[long_enough], offsets[long_enough + 1] - length
    cuts = np.unique(np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, chosen[:-1][tie] + 1, first, last + 1]))
    cuts = cuts[cuts <= len(least)]
    start, count = cuts[:-1], np.diff(cuts)
    text = np.searchsorted(offsets, start, "right") - 1
    valid = start + length <= offsets[text + 1]
    start, count, text = start[valid], count[valid], text[valid]
    return least[start], span_hash(total, start, start + count - 1 + length), text, start - offsets[text], count


def _names(symbols: np.ndarray) -> dict[int, np.ndarray]:
    """Ranks of the blocks of 8, 16, 32 and 64 symbols that start at each place; equal blocks have equal ranks."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(8, np.uint64)])
    # Symbols are below 2**8 after ranking within the text, so eight of them fill one number.
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : n + k]
    out = {}
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
    out[8] = rank
    for size in (8, 16, 32):
        later = np.zeros(n, np.int64)
        if n > size:
            later[: n - size] = rank[size:] + 1
        rank = np.unique((rank << 32) | later, return_inverse=True)[1].astype(np.int64)
        out[2 * size] = rank
    return out


def _smaller_than_next(symbols: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successors; the last one is not."""
    n = len(symbols)
    step = np.zeros(n, np.int32)
    step[:-1] = np.sign(symbols[1:].astype(np.int32) - symbols[:-1])
    step[-1] = -1
    place = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(place[::-1])[::-1]] > 0


def _sort_directly(suffixes: np.ndarray, names: dict[int, np.ndarray], depth: int) -> np.ndarray:
    """Order suffixes by their first `depth` symbols or more, 64 at a time, looking again only at ties."""
    name = names[64]
    n = len(name)
    order = suffixes[np.argsort(name[suffixes], kind="stable")]
    group = np.cumsum(np.concatenate([[0], np.diff(name[order]) != 0])) if len(order) else np.zeros(0, np.int64)
    reached = 64
    while reached < depth and len(order):
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        later = order[at] + reached
        key = np.where(later < n, name[np.minimum(later, n - 1)] + 1, 0)
        both = (group[at] << 32) | key
        turn = np.argsort(both, kind="stable")
        order[at], both = order[at][turn], both[turn]
        fresh = np.zeros(len(order), np.int64)
        fresh[at[1:]] = (both[1:] != both[:-1]) & (both[1:] >> 32 == both[:-1] >> 32)
        group = group + np.cumsum(fresh)
        reached += 64
    return order


def suffix_array(symbols: np.ndarray, depth: int, names: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols at least, by two-stage sorting."""
    symbols = np.ascontiguousarray(symbols)
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    names = names or _names(symbols)
    small = _smaller_than_next(symbols)
    direct = _sort_directly(np.flatnonzero(small), names, depth)
    bounds = np.searchsorted(symbols[direct], np.arange(258))  # direct is in order of its first symbols
    arrived: list[list[np.ndarray]] = [[] for _ in range(257)]
    arrived[symbols[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(257):
        waves = [np.concatenate(arrived[c])] if arrived[c] else []
        while waves and len(waves[-1]):
            before = waves[-1][waves[-1] > 0] - 1
            waves.append(before[(symbols[before] == c) & ~small[before]])
        bucket = np.concatenate([*waves, direct[bounds[c] : bounds[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~small[before] & (symbols[before] > c)]
        if len(before):
            into = symbols[before]
            turn = np.argsort(into, kind="stable")
            before, into = before[turn], into[turn]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(into)) + 1, [len(into)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                arrived[into[a]].append(before[a:b])
        arrived[c] = []
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, symbols: np.ndarray, names: dict[int, np.ndarray], most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, up to `most`; 0 for the first."""
    n = len(symbols)
    a, b = order[:-1], order[1:]
    prefix = np.zeros(len(a), np.int64)
    for size, times in ((64, most // 64), (32, 1), (16, 1), (8, 1)):
        for _ in range(times):
            x, y = a + prefix, b + prefix
            fits = (np.maximum(x, y) + size <= n) & (prefix + size <= most)
            same = fits & (names[size][np.minimum(x, n - 1)] == names[size][np.minimum(y, n - 1)])
            prefix += size * same
    for _ in range(8):
        x, y = a + prefix, b + prefix
        fits = (np.maximum(x, y) < n) & (prefix < most)
        prefix += fits & (symbols[np.minimum(x, n - 1)] == symbols[np.minimum(y, n - 1)])
    return np.concatenate([[0], prefix])


def repeated_starts(pieces: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """For the windows of all pieces in turn, `counts` each: does the window occur twice among them?"""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    # Separators become the symbol 0 and bytes their rank among those that occur: at most 255 fit beside it.
    present = np.zeros(256, bool)
    present[data] = True
    ends = starts + sizes
    mask = np.ones(len(data), bool)
    mask[ends] = False
    ranks = np.cumsum(present)
    symbols = np.where(mask, ranks[data], 0).astype(np.uint16)
    if symbols.max() > 255:
        raise ValueError("UTF-8 has fewer than 256 different bytes")
    names = _names(symbols)
    order = suffix_array(symbols, length, names)
    owned = np.zeros(len(data) + 1, np.int64)
    owned[starts] += 1
    owned[starts + counts] -= 1
    owned = np.cumsum(owned[:-1]) > 0
    order = order[owned[order]]
    deep = common_prefixes(order, symbols, names, length) >= length
    hit = deep.copy()
    hit[:-1] |= deep[1:]
    flags = np.zeros(len(data), bool)
    flags[order] = hit
    return flags[owned]


def repeated_windows(pieces: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """As `repeated_starts`, which gets only the parts of the pieces with windows whose hash another one has."""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    begins = np.cumsum(sizes) - sizes
    bounds = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(pieces)), counts)
    at = begins[owner] + np.arange(bounds[-1]) - bounds[owner]
    total = Block(0, data, np.array([0, len(data)])).prefix_hash()
    hashes = span_hash(total, at, at + length)
    slot = (hashes >> np.uint64(64 - max(10, 1 + int(bounds[-1]).bit_length()))).astype(np.int64)
    likely = np.flatnonzero(np.bincount(slot)[slot] > 1)  # equal hashes share a slot; the rest needs no sort
    _, place, often = np.unique(hashes[likely], return_inverse=True, return_counts=True)
    hit = likely[often[place] > 1]
    flags = np.zeros(len(at), bool)
    if not len(hit):
        return flags
    # Windows that overlap go together, so that no byte is sorted twice.
    cut = np.flatnonzero((np.diff(hit) >= length) | (np.diff(owner[hit]) != 0))
    first, last = hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])]
    parts = [data[a:b].tobytes() for a, b in zip(at[first].tolist(), (at[last] + length).tolist(), strict=True)]
    inside = np.zeros(len(at) + 1, np.int64)
    inside[first] += 1
    inside[last + 1] -= 1
    flags[np.cumsum(inside[:-1]) > 0] = repeated_starts(parts, last - first + 1, length)
    return flags


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_d"), F.xxhash64(text).alias("_t"), text.alias("_text"))


_KEY = "_d long, _t long"


def _parts(whole: Iterator[Block], length: int, limit: int = PART_BYTES) -> Iterator[tuple[Block, int]]:
    """Blocks, with long texts in parts that own `limit` windows each, and how many bytes of the text stand before a part."""
    for block in whole:
        n = len(block.data)
        if len(block) > 1 or n <= limit + length:
            yield block, 0
            continue
        for at in range(0, n - length + 1, limit):
            part = block.data[at : at + limit + length - 1]
            yield Block(block.first, part, np.array([0, len(part)])), at


def _all_pieces(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, skipped in _parts(blocks(batch.column(2)), length):
                group, piece, text, start, count = pieces_of(block, length, gram)
                start = start + skipped
                if len(start):
                    row = pa.array(block.first + text)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(row), batch.column(1).take(row), pa.array(group.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(start), pa.array(count)], names=["_d", "_t", "h", "p", "a", "n"]
                    )

    return keyed.select("_d", "_t", "_text").mapInArrow(run, f"{_KEY}, h long, p long, a long, n long")


def _fetch(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted pieces."""
    per_text = wanted.groupBy("_d", "_t").agg(F.collect_list(F.struct("h", "a", "n", "c")).alias("_w"))  # bounded by the text
    joined = keyed.select("_d", "_t", "_text").join(per_text, ["_d", "_t"]).select("_d", "_t", F.col("_text").cast("binary").alias("_text"), "_w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, asked = batch.column(2)[k].as_py(), batch.column(3)[k].values
                h, a, n, c = (asked.field(i) for i in range(4))
                cut = [text[x : x + y - 1 + length] for x, y in zip(a.to_pylist(), n.to_pylist(), strict=True)]
                row = pa.array(np.full(len(cut), k))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), h, a, n, c, pa.array(cut, pa.binary())], names=["_d", "_t", "h", "a", "n", "c", "bytes"])

    return joined.mapInArrow(run, f"{_KEY}, h long, a long, n long, c long, bytes binary")


def _sorted_marks(pieces: DataFrame, length: int, chunk: int) -> DataFrame:
    """Repeated windows of the pieces that occur once, by suffix arrays over whole groups."""
    dealt = pieces.repartition("h").sortWithinPartitions("h")

    def solve(group: pa.Table) -> pa.RecordBatch:
        count = group["n"].to_numpy()
        flags = repeated_windows(group["bytes"].to_pylist(), count, length)
        single = np.repeat(group["c"].to_numpy() == 1, count)
        bounds = np.concatenate([[0], np.cumsum(count)])
        edge = np.zeros(len(flags), bool)
        edge[bounds[:-1]] = True
        flags &= single
        # Runs that don't cross pieces.
        begin = np.flatnonzero(flags & (edge | ~np.concatenate([[False], flags[:-1]])))
        end = np.flatnonzero(flags & np.concatenate([edge[1:] | ~flags[1:], [True]])) + 1
        piece = np.searchsorted(bounds, begin, "right") - 1
        row = pa.array(piece)
        start = group["a"].to_numpy()[piece] + begin - bounds[piece]
        return pa.RecordBatch.from_arrays([group["_d"].combine_chunks().take(row), group["_t"].combine_chunks().take(row), pa.array(start), pa.array(end - begin)], names=["_d", "_t", "a", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                # Cut at the end of a group once enough is held.
                h = batch["h"].to_numpy()
                lengths = np.cumsum(batch["n"].to_numpy() + length)
                k = int(np.searchsorted(lengths, max(chunk - size, 1)))
                if k >= batch.num_rows:
                    held.append(batch)
                    size += int(lengths[-1])
                    break
                if k == 0 and held and held[-1]["h"][-1].as_py() != h[0]:
                    stop = 0
                else:
                    rest = np.flatnonzero(h[k:] != h[k])
                    stop = k + int(rest[0]) if len(rest) else batch.num_rows
                if stop >= batch.num_rows:
                    held.append(batch)
                    size += int(lengths[-1])
                    break
                if stop:
                    held.append(batch.slice(0, stop))
                yield solve(pa.Table.from_batches(held))
                held, size = [], 0
                batch = batch.slice(stop)
        if held:
            yield solve(pa.Table.from_batches(held))

    return dealt.select("_d", "_t", "h", "a", "n", "c", "bytes").mapInArrow(run, f"{_KEY}, a long, n long")


def _counted_marks(pieces: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the pieces that occur once, each window dealt out by its hash; for very large groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["bytes"]):
                row = np.arange(block.first, block.first + len(block))
                count = batch["n"].to_numpy()[row]
                index = np.repeat(np.arange(len(row)), count)
                inner = np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)
                at = block.offsets[index] + inner
                w = span_hash(block.prefix_hash(), at, at + length)
                take = pa.array(row[index])
                yield pa.RecordBatch.from_arrays([batch["_d"].take(take), batch["_t"].take(take), batch["h"].take(take), pa.array(w.view(np.int64)), pa.array(batch["a"].to_numpy()[row[index]] + inner), batch["c"].take(take)], names=["_d", "_t", "h", "w", "a", "c"])

    windows = written(pieces.select("_d", "_t", "h", "a", "n", "c", "bytes").mapInArrow(run, f"{_KEY}, h long, w long, a long, c long"), "windows")
    often = windows.groupBy("h", "w").agg(F.sum("c").alias("_n")).where(F.col("_n") > 1).select("h", "w")
    return windows.where(F.col("c") == 1).join(often, ["h", "w"], "left_semi").select("_d", "_t", "a", F.lit(1).cast("long").alias("n"))


def marks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT, chunk: int = CHUNK_BYTES) -> DataFrame:
    """For every text with repeated windows, by (_d, _t): `_m`, its runs of repeated windows (first start, how many)."""
    keyed = _keyed(docs)
    rows = written(_all_pieces(keyed, length, gram), "pieces")
    # Written first, so that the join has nothing but plain sides, which adaptive execution can split at a hot group.
    shared = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("h"), "meeting")
    kept = written(rows.join(shared, "h", "left_semi"), "shared", rows, shared)
    different = written(kept.groupBy("h", "p", "n").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("_d", "_t", "a")).alias("_at")), "different")
    equal = kept.join(different.where(F.col("c") > 1).select("h", "p", "n"), ["h", "p", "n"], "left_semi").select("_d", "_t", "a", "n")
    groups = different.groupBy("h").agg(F.count(F.lit(1)).alias("_k"), F.min("c").alias("_least")).where((F.col("_k") > 1) & (F.col("_least") == 1))
    wanted = different.join(groups.select("h", "_k"), "h")
    wanted = wanted.select("h", "n", "c", "_k", F.col("_at._d").alias("_d"), F.col("_at._t").alias("_t"), F.col("_at.a").alias("a"))
    fetched = written(_fetch(keyed, wanted, length), "bytes")
    large = groups.where(F.col("_k") > group_limit).select("h")
    usual = fetched.join(large, "h", "left_anti")
    rest = fetched.join(large, "h", "left_semi")
    found = equal.unionByName(_sorted_marks(usual, length, chunk)).unionByName(_counted_marks(rest, length))
    found = written(found, "marks", kept, different, fetched)
    return found.groupBy("_d", "_t").agg(F.collect_list(F.struct("a", "n")).alias("_m"))  # bounded by the text


def _removed(size: int, a: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs of a text."""
    order = np.argsort(a, kind="stable")
    begin, end = a[order], np.maximum.accumulate((a + n - 1 + length)[order])
    fresh = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[fresh], end[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(end) - 1]])]


def _with_marks(docs: DataFrame, carried: Column, length: int, **how) -> DataFrame:
    """`carried`, and _text and _m of every row."""
    found = marks(docs, length, **how)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(carried, text.cast("binary").alias("_text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_d"), F.xxhash64(text).alias("_t"))
    return base.join(found, ["_d", "_t"], "left").drop("_d", "_t")


def _spans_of(batch: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    none = np.zeros(0, np.int64)
    texts, found = batch["_text"], batch["_m"]
    for k in range(batch.num_rows):
        text = texts[k].as_py()
        m = found[k].values
        if m is None or not len(m):
            yield text, none, none
        else:
            yield text, *_removed(len(text), m.field(0).to_numpy(), m.field(1).to_numpy(), length)


def digest(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, spans, sha = [], [], [], []
            for text, begin, end in _spans_of(batch, length):
                size.append(len(text))
                gone.append(int((end - begin).sum()))
                spans.append(len(begin))
                left = hashlib.sha256()
                at = 0
                for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                    left.update(text[at:b])
                    at = e
                left.update(text[at:] if at else text)
                sha.append(left.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_marks(docs, F.col("doc_id"), length, **how).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """The input's columns with the repeated strings cut out of `text`; a character cut in two goes whole."""
    # One struct carries the row, so that no name of a column meets those used here.
    told = _with_marks(docs, F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("_row"), length, **how)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch["_row"].flatten()
            texts = []
            for k, (text, begin, end) in enumerate(_spans_of(batch, length)):
                if not len(begin):
                    texts.append(columns[place][k].as_py())
                    continue
                parts, at = [], 0
                for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                    parts.append(text[at:b])
                    at = e
                parts.append(text[at:])
                texts.append(b"".join(parts).decode("utf-8", "ignore"))
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    return told.select("_row", "_text", "_m").mapInArrow(run, docs.schema)
