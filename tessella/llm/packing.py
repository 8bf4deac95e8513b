"""Packing token sequences by cutting-stock column generation (operator 6).

Every document becomes token ids with a closing id 0, cut into pieces of `width` ids and one shorter rest.
The histogram of the pieces' lengths in units of `GRAIN` ids - at most `width / GRAIN` numbers, whatever the
corpus - defines a cutting-stock linear program whose columns are patterns of lengths. Columns are priced by a
knapsack dynamic program; Farley's bound ends the search. The rounded-down patterns, and best-fit bins for
what rounding leaves, are laid out in order, and each document's piece takes the slot of its rank among the
pieces of its length. Offsets are then running sums within a sequence.

A null text is empty and becomes the single id 0. Repeated rows are packed once each. Pieces of one length are ranked by
doc_id, start and checksum within groups drawn by a hash; those equal in all are alike, so it does not matter which takes
which slot. A task holds the ids of one text at a time, about 40 bytes each. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessella.llm.stage import written

WIDTH = 1024
#: Lengths count in units of so many ids, rounded up: a few ids of padding a piece for a program of 256 rows.
GRAIN = 4
RANK_GROUP = 50_000
#: Runs of so much white space go to the file's own library: the faster BPE looks back over a run and needs a stack as deep.
LONG_RUN = 50_000
_BLANK = re.compile(r"\s{2,}")

_encoders: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: printable ones as themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(path: str):
    """Function from a text to its ids by a byte-level BPE vocabulary file; one per Python worker.

    The file's own vocabulary drives a faster BPE than the file's library has; both give the same ids. As in the
    library, texts are split at the file's added tokens first, the longest of those that start together.
    """
    if path not in _encoders:
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        added = stored.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} has added tokens that take in or depend on what stands beside them")
        special = {t["content"]: t["id"] for t in added}
        back = _byte_of_symbol()
        ranks = {bytes(back[c] for c in token): rank for token, rank in stored["model"]["vocab"].items() if token not in special}
        plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        split = re.compile(f"({'|'.join(map(re.escape, sorted(special, key=len, reverse=True)))})").split if special else None

        library = Tokenizer.from_file(path)

        def encode(text: str) -> list[int]:
            if len(text) > LONG_RUN and any(m.end() - m.start() > LONG_RUN for m in _BLANK.finditer(text)):
                return library.encode(text, add_special_tokens=False).ids
            parts = split(text) if split else [text]
            if len(parts) == 1:
                return plain(text)
            # Every second part is an added token.
            return [i for k, part in enumerate(parts) for i in ([special[part]] if k % 2 else plain(part))]

        _encoders[path] = encode
    return _encoders[path]


PIECE_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, width: int = WIDTH) -> DataFrame:
    """doc_id and start, length, ids_crc32 and doc_tokens of every piece of every whole text."""
    kept = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, {PIECE_SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                row, out = [], []
                for k, text in enumerate(part.column(1)):
                    ids = encode(text.as_py() or "")
                    ids.append(0)
                    raw = np.array(ids, "<u4").tobytes()
                    n = len(ids)
                    for begin in range(0, n, width):
                        stop = min(begin + width, n)
                        row.append(k)
                        out.append((begin, stop - begin, zlib.crc32(raw[4 * begin : 4 * stop]), n))
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return kept.mapInArrow(run, schema)


def knapsack(values: np.ndarray, sizes: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of items within the width, by dynamic programming over capacities."""
    best = np.zeros(width + 1)
    pick = np.full(width + 1, -1)
    for room in range(int(sizes.min()), width + 1):
        n = int(np.searchsorted(sizes, room, "right"))
        tries = values[:n] + best[room - sizes[:n]]
        k = int(tries.argmax())
        if tries[k] > best[room - 1] + 1e-12:
            best[room], pick[room] = tries[k], k
        else:
            best[room] = best[room - 1]
    counts = np.zeros(len(sizes), np.int64)
    room = width
    while room > 0:
        if pick[room] < 0:
            room -= 1
            continue
        counts[pick[room]] += 1
        room -= int(sizes[pick[room]])
    return float(best[width]), counts


def greedy_basis(sizes: np.ndarray, demand: np.ndarray, width: int) -> np.ndarray:
    """First patterns, one a size: as many of it as fit, topped up with smaller sizes of which enough is left."""
    left = demand.astype(float).copy()
    patterns = np.zeros((len(sizes), len(sizes)), np.int64)
    for k in range(len(sizes) - 1, -1, -1):
        patterns[k, k] = width // sizes[k]
        times = left[k] / patterns[k, k]
        room = width - int(patterns[k, k] * sizes[k])
        left[k] = 0
        for j in range(k - 1, -1, -1):
            while sizes[j] <= room and left[j] >= times > 0:
                patterns[k, j] += 1
                left[j] -= times
                room -= int(sizes[j])
    return patterns


def inverse_of_triangle(lower: np.ndarray) -> np.ndarray:
    """Inverse of a lower triangular matrix by forward substitution; small, and free of threaded libraries."""
    n = len(lower)
    out = np.zeros((n, n))
    for k in range(n):
        out[k] = -np.einsum("j,ji->i", lower[k, :k].astype(float), out[:k])
        out[k, k] += 1
        out[k] /= lower[k, k]
    return out


def column_generation(sizes: np.ndarray, demand: np.ndarray, width: int, gap: float = 5e-4, rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Basis patterns (rows) and how often each is used in the linear program: meet the demand with fewest sequences."""
    m = len(sizes)
    patterns = greedy_basis(sizes, demand, width)
    inverse = inverse_of_triangle(patterns).T.copy()
    level = np.maximum(np.einsum("ij,j->i", inverse, demand), 0)
    bound = 0.0
    for _ in range(rounds):
        prices = inverse.sum(0)
        worth, column = knapsack(np.maximum(prices, 0), sizes, width)
        bound = max(bound, float(level.sum()) / max(worth, 1.0))
        if worth <= 1 + 1e-9 or level.sum() <= bound * (1 + gap):
            break
        way = np.einsum("ij,j->i", inverse, column.astype(float))
        rising = way > 1e-9
        ratio = np.full(m, np.inf)
        ratio[rising] = level[rising] / way[rising]
        k = int(ratio.argmin())
        if not np.isfinite(ratio[k]):
            break
        step = max(float(ratio[k]), 0.0)
        level -= step * way
        level[k] = step
        pivot = inverse[k] / way[k]
        inverse -= way[:, None] * pivot[None, :]
        inverse[k] = pivot
        patterns[k] = column
    return patterns, np.maximum(level, 0)


def best_fit(left: np.ndarray, sizes: np.ndarray, width: int) -> Counter:
    """Patterns of bins that take all remaining items, longest first, each into the fullest bin with room."""
    open_bins: dict[int, list[list[int]]] = {}
    for k in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[k])):
            size = int(sizes[k])
            room = next((r for r in range(size, width) if open_bins.get(r)), None)
            chosen = open_bins[room].pop() if room is not None else []
            chosen.append(size)
            open_bins.setdefault((room if room is not None else width) - size, []).append(chosen)
    return Counter(tuple(sorted(b, reverse=True)) for bins in open_bins.values() for b in bins)


def plan(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order) and the number of sequences of each; together they hold exactly the histogram."""
    full = histogram.get(width, 0)
    made: list[tuple[tuple[int, ...], int]] = [((width,), full)] if full else []
    sizes = np.array(sorted(k for k, n in histogram.items() if n > 0 and k != width), np.int64)
    if not len(sizes):
        return made
    demand = np.array([histogram[int(k)] for k in sizes], np.int64)
    patterns, level = column_generation(sizes, demand.astype(float), width)
    left = demand.copy()
    for j in np.argsort(-level, kind="stable"):
        row = patterns[j]
        used = row > 0
        times = int(np.floor(level[j] + 1e-9))
        times = min(times, int((left[used] // row[used]).min()))
        if times > 0:
            left -= times * row
            made.append((tuple(int(s) for k in np.argsort(-sizes) for s in [sizes[k]] * int(row[k])), times))
    made += sorted(best_fit(left, sizes, width).items(), reverse=True)
    return made


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """For every length: first rank, first sequence, and place in it, of each run of equal slots."""
    out = []
    sequence = 0
    next_rank: Counter = Counter()
    for lengths, times in patterns:
        for place, length in enumerate(lengths):
            out.append((length, next_rank[length], sequence, place))
            next_rank[length] += times
        sequence += times
    return out


def pack(docs: DataFrame, path: str | None = None, width: int = WIDTH, grain: int = GRAIN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path or default_tokenizer(), width), "pieces").withColumn("_size", F.ceil(F.col("length") / grain).cast("long"))
    histogram = {r["_size"]: r["n"] for r in cut.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most width / grain rows
    layout = slots(plan(histogram, width // grain))

    # A rank among equal lengths: groups of bounded size by a hash, each counted first, then ordered within.
    groups = spark.createDataFrame([(k, -(-n // RANK_GROUP)) for k, n in histogram.items()] or [(0, 1)], "_size long, _groups long")
    dealt = cut.join(F.broadcast(groups), "_size")  # at most width / grain rows
    dealt = dealt.withColumn("_group", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "start", "ids_crc32"), F.col("_groups")))
    sums = dealt.groupBy("_size", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_size").orderBy("_group")) - F.col("_n")
    sums = sums.select("_size", "_group", before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_size", "_group").orderBy("doc_id", "start", "ids_crc32", "length")) - 1
    ranked = dealt.withColumn("_inner", inner).join(sums, ["_size", "_group"]).withColumn("_rank", F.col("_before") + F.col("_inner"))

    # The layout has a run for each pattern and length in it: bounded by the square of width / grain.
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for size, first, sequence, place in layout:
        runs.setdefault(size, []).append((first, sequence, place))
    shared = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in runs.items()})
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    final = ranked.select(*names, "_size", "_rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in final.schema.fields[:5]) + ", sequence_id long, _place long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            size, rank = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            sequence, seat = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(size):
                at = np.flatnonzero(size == k)
                run = table[int(k)]
                row = np.searchsorted(run[:, 0], rank[at], "right") - 1
                sequence[at] = run[row, 1] + rank[at] - run[row, 0]
                seat[at] = run[row, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(seat)], names=[*names, "sequence_id", "_place"])

    seated = final.mapInArrow(place, schema)
    ahead = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("_place")) - F.col("length")
    return seated.select(*names, "sequence_id", ahead.alias("offset"))
