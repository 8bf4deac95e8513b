"""The whole suffix tree of a language model as distributed tables (operator 7).

A run of words that is a context of depth d is also the context of depth d - 1 behind its first word, with a symbol; so
all counts are those of runs of 2 to depth + 1 words. They are counted level by level: a run of which the part before the
last word can't be a state is not counted. A state's log-likelihood gain must exceed `SIGNIFICANCE` standard
deviations; by the Cauchy-Schwarz inequality it can't with `SIGNIFICANCE` squared tokens or fewer, which leaves out no state.
An entry has `LEAST_COUNT` tokens or more, at any size of the input; all other successors of a state share its rest.

Texts lie in batches of about `BATCH` tokens, each a dictionary and places in it. A batch sends its counts as arrays to buckets of
hashes, where they are summed. It asks once for each of its runs that may be in the tree; questions and answers meet in such buckets
and return to their batch. At most `HEAD` of the commonest runs reach every task, and nobody asks for them. Bitmaps of fixed size
(`sieve`) only leave out questions and counts that have no effect. A task holds one batch, or one text if that is longer.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F

from tessella.llm.sieve import passes, sieve, slot_sieve, slotted
from tessella.llm.stage import dropped, settled
from tessella.llm.textblock import blocks, mix

BATCH = 1 << 20
#: Tokens of the table for each bucket in which questions meet answers, about.
BUCKET = 1_000_000
#: Rows of the tree that reach every task at most; only the number of questions depends on it.
HEAD = 1 << 20
LEAST_COUNT = 3
STRENGTH = 20.0  # weight of the suffix's distribution, in tokens
SIGNIFICANCE = 3.0
#: The fewest tokens of a state.
LEAST_STATE = int(SIGNIFICANCE**2) + 1


COLUMNS = ("batch", "doc_id", "held", "size", "words", "low", "high")


@dataclass
class Batch:
    number: int
    doc_id: pa.Array
    held: np.ndarray
    text: np.ndarray  # of each token
    words: np.ndarray  # hashes of the different ones
    place: np.ndarray  # of each token among these

    @property
    def token(self) -> np.ndarray:
        return self.words[self.place]

    def training(self) -> tuple[np.ndarray, np.ndarray]:
        own = ~self.held[self.text]
        return self.words[self.place[own]], self.text[own]

    def runs_in_tree(self, known: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of 2 words and more, the places where one ends that may be in the tree, and its keys."""
        keys, at = self.token, np.arange(1, len(self.place))
        for k in range(1, depth + 1):
            keys = longer(keys)
            at = at[at >= k]
            at = at[self.text[at] == self.text[at - k]]
            at = at[passes(known, keys[at])]  # a run in the tree is there without its first word, too
            yield at, keys[at]


def batched(own: DataFrame, tokens) -> DataFrame:
    """Batches of the texts of a table of doc_id, held_out and text; `tokens` gives the hashes of a block's tokens and the text of each."""
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        gathered: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, held, sizes, found = zip(*gathered, strict=True)
            values, place = np.unique(np.concatenate(found), return_inverse=True)
            columns = [pa.concat_arrays(ids), pa.concat_arrays(held), pa.array(np.concatenate(sizes))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            raw = [values.tobytes(), (place & 0xFFFF).astype("<u2").tobytes(), (place >> 16).astype("<u2").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([number]), *lists, *(pa.array([x], pa.binary()) for x in raw)], names=["batch", "doc_id", "held", "size", "words", "low", "high"])

        for part in parts:
            for block in blocks(part.column(2)):
                found, text = tokens(block)
                row = slice(block.first, block.first + len(block))
                gathered.append((part.column(0)[row], part.column(1)[row], np.bincount(text, minlength=len(block)), found))
                size += len(found)
                if size >= BATCH:
                    yield flush()
                    gathered, size = [], 0
                    number += 1
        if gathered:
            yield flush()

    return own.mapInArrow(run, f"batch long, doc_id array<{kind}>, held array<boolean>, size array<long>, words binary, low binary, high binary")


def opened(table: pa.RecordBatch | pa.Table) -> Iterator[Batch]:
    for k in range(table.num_rows):
        low, high = (np.frombuffer(table[c][k].as_py(), "<u2").astype(np.int32) for c in ("low", "high"))
        words = np.frombuffer(table["words"][k].as_py(), np.uint64)
        size = table["size"][k].values.to_numpy()
        yield Batch(table["batch"][k].as_py(), table["doc_id"][k].values, table["held"][k].values.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size), dtype=np.int32), size), words, low | (high << 16))


def joined(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Keys of runs from those of all but the last of their words, and of all but the first."""
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + after)


def longer(keys: np.ndarray) -> np.ndarray:
    """Keys of the runs that end at each token, one word longer; whether they lie in one text is not looked at."""
    out = np.zeros_like(keys)
    out[1:] = joined(keys[:-1], keys[1:])
    return out


def runs(token: np.ndarray, text: np.ndarray, often: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of len(often) + 1 words without the last and without the first, if all shorter runs at their start pass the sieves."""
    keys, at = token, np.arange(1, len(token))
    for k, bits in enumerate(often, 1):
        at = at[at >= k]
        at = at[text[at] == text[at - k]]
        at = at[passes(bits, keys[at - 1])]
        if k < len(often):
            keys = longer(keys)
    return keys[at - 1], keys[at]


def edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket of sorted keys begins; one more at the end."""
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def dealt(keys: np.ndarray, bits: int, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket of sorted keys in use, with the bytes of its part of each column."""
    edge = edges(keys, bits)
    used = np.flatnonzero(np.diff(edge) > 0)
    bounds = np.append(edge[used], edge[-1])
    told = {name: pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer((bounds * x.itemsize).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())]) for name, x in columns.items()}
    return pa.RecordBatch.from_pydict({"bucket": pa.array(used.astype(np.int32))} | told)


def gathered(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def runs_of_equals(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts keys, and where in it each different one begins."""
    order = np.argsort(keys)
    keys = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def count_words(stored: DataFrame, bits: int) -> tuple[DataFrame, int, int]:
    """The table of the counts of all words of training texts (w, c), their sum and the number of words."""

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch in opened(part):
                count = np.bincount(batch.place[~batch.held[batch.text]], minlength=len(batch.words))
                at = np.flatnonzero(count)
                yield dealt(batch.words[at], bits, words=batch.words[at], counts=count[at].astype(np.uint32))

    def add(table: pa.Table) -> pa.Table:
        words, counts = gathered(table["words"], np.uint64), gathered(table["counts"], np.uint32).astype(np.int64)
        order, first = runs_of_equals(words)
        return pa.table({"w": words[order[first]].view(np.int64), "c": np.add.reduceat(counts[order], first)})

    sent = stored.select(*COLUMNS).mapInArrow(send, "bucket int, words binary, counts binary")
    words = settled(sent.groupBy("bucket").applyInArrow(add, "w long, c long"), "words")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    return words, sums["n"], sums["v"]


def count_runs(stored: DataFrame, often: list[Broadcast], bits: int) -> DataFrame:
    """pre, suf, key and c of the runs of len(often) + 1 words that occur `LEAST_COUNT` times in training texts."""

    def found(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in opened(part):
            yield runs(*batch.training(), [b.value for b in often])

    slot_rows = stored.select(*COLUMNS).mapInArrow(lambda parts: slotted(joined(a, b) for part in parts for a, b in found(part)), "part int, low binary, high binary, counts binary")
    repeated = slot_sieve(slot_rows, LEAST_COUNT, free=True)

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for pre, suf in found(part):
                key = joined(pre, suf)
                at = np.flatnonzero(passes(repeated.value, key))
                order, first = runs_of_equals(key[at])
                count = np.diff(np.append(first, len(at)))
                at = at[order[first]]
                yield dealt(key[at], bits, pre=pre[at], suf=suf[at], counts=count.astype(np.uint32))

    def add(table: pa.Table) -> pa.Table:
        pre, suf, counts = gathered(table["pre"], np.uint64), gathered(table["suf"], np.uint64), gathered(table["counts"], np.uint32).astype(np.int64)
        key = joined(pre, suf)
        order, first = runs_of_equals(key)
        count = np.add.reduceat(counts[order], first)
        at, count = order[first[count >= LEAST_COUNT]], count[count >= LEAST_COUNT]
        return pa.table({"pre": pre[at].view(np.int64), "suf": suf[at].view(np.int64), "key": key[at].view(np.int64), "c": count})

    sent = stored.select(*COLUMNS).mapInArrow(send, "bucket int, pre binary, suf binary, counts binary")
    told = settled(sent.groupBy("bucket").applyInArrow(add, "pre long, suf long, key long, c long"), "runs")
    repeated.unpersist()
    return told


def states_of(counted: DataFrame, contexts: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States (key, total, dropped) and their entries (key, c, p) of one depth.

    `contexts` (key, total) are the candidates, `before` (key, p) the probabilities of the entries of their suffixes.
    """
    entries = counted.join(contexts.select(F.col("key").alias("pre"), "total"), "pre").join(before.select(F.col("key").alias("suf"), F.col("p").alias("_p")), "suf")
    entries = settled(entries.select("pre", "key", "c", "total", "_p"), "candidates")
    shares = settled(entries.groupBy("pre").agg((F.first("total") - F.sum("c")).alias("dropped")), "shares")
    c, total, less = F.col("c"), F.col("total"), F.col("total") - 1 + STRENGTH
    rest = F.col("dropped") + STRENGTH
    # Each token predicted from all others. Without one of its tokens an entry at the threshold would be part of the rest.
    gain = F.log(F.when(c - 1 >= LEAST_COUNT, ((c - 1) / F.col("_p") + rest) / less).otherwise((rest + c - 1) / less))
    both = entries.join(shares, "pre")
    sums = both.groupBy("pre").agg(F.first("total").alias("total"), F.first("dropped").alias("dropped"), F.sum(c * gain).alias("_s"), F.sum(c * gain * gain).alias("_q"))
    lost = F.log((STRENGTH + F.greatest(F.col("dropped") - 1, F.lit(0))) / less)
    good = F.col("_s") + F.col("dropped") * lost > SIGNIFICANCE * F.sqrt(F.col("_q") + F.col("dropped") * lost * lost)
    states = settled(sums.where(good).select(F.col("pre").alias("key"), "total", "dropped"), "states")
    kept = both.join(states.select(F.col("key").alias("pre")), "pre", "left_semi")
    kept = settled(kept.select("key", "c", ((c + rest * F.col("_p")) / (total + STRENGTH)).alias("p")), "entries", entries, shares)
    return states, kept


def grow(stored: DataFrame, words: DataFrame, n: int, v: int, bits: int, depth: int) -> DataFrame:
    """The tree: key, c and left, in one row for a word or an entry of a state (left 0), and one for a state (the tokens that its entries leave out, and 1)."""
    tree = words.select(F.col("w").alias("key"), "c", F.lit(0).cast("long").alias("left"))
    contexts = words.where(F.col("c") >= LEAST_STATE).select(F.col("w").alias("key"), F.col("c").alias("total"))
    before = words.select(F.col("w").alias("key"), ((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1))).alias("p"))
    frequent, often, last = contexts, [], []
    for _ in range(depth):
        often.append(sieve(frequent.select(F.col("key").alias("k")), free=True))
        counted = count_runs(stored, often, bits)
        states, entries = states_of(counted, contexts, before)
        dropped(*last)
        last = [counted]
        if states.isEmpty():
            break
        tree = tree.unionByName(entries.select("key", "c", F.lit(0).cast("long").alias("left"))).unionByName(states.select("key", F.col("total").alias("c"), (F.col("dropped") + 1).alias("left")))
        frequent = counted.where(F.col("c") >= LEAST_STATE)
        contexts = frequent.join(states.select(F.col("key").alias("suf")), "suf", "left_semi").select("key", F.col("c").alias("total"))
        before = entries
    dropped(*last)
    for bits_of in often:
        bits_of.unpersist()
    return tree


@dataclass
class Head:
    """Rows of the tree, one for each key, by key."""

    keys: np.ndarray
    c: np.ndarray
    left: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Head:
        keys, c, left = table["key"].to_numpy().view(np.uint64), table["c"].to_numpy(), table["left"].to_numpy()
        # A state that is an entry, too, has the same count in both rows. One that is no entry follows no state, and its count is read as its total only.
        order = np.lexsort((left, keys))
        keys = keys[order]
        at = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) if len(keys) else np.zeros(0, np.int64)
        return cls(keys[at], c[order[at]], left[order[at]])

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the asked keys are here, and where."""
        place = np.searchsorted(self.keys, asked)
        if not len(self.keys):
            return np.zeros(len(asked), bool), place
        place = np.minimum(place, len(self.keys) - 1)
        return self.keys[place] == asked, place


def head(tree: DataFrame) -> Broadcast:
    """The rows of the tree whose count is in the highest classes that hold `HEAD` rows at most; both rows of a key have one count."""
    level = F.floor(F.log2("c") * 4).cast("int")
    most, size = 1 << 30, 0
    for row in tree.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 256 rows
        size += row["count"]
        if size > HEAD:
            break
        most = row["level"]
    return tree.sparkSession.sparkContext.broadcast(Head.of(tree.where(level >= most).toArrow()))


def distinct(keys: np.ndarray) -> np.ndarray:
    """Different keys, sorted."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def questions(batch: Batch, found: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sorted keys of all words of a batch, and of its `runs_in_tree`."""
    return distinct(np.concatenate([batch.words, *(distinct(keys) for _, keys in found)]))


def places(asked: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys among sorted ones, looked up in order, which is faster."""
    order = np.argsort(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.searchsorted(asked, keys[order])
    return out


def _bytes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest of all first, and as many as the largest needs."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def _numbers(raw: bytes, many: int) -> np.ndarray:
    out = np.zeros((8, many), np.uint8)
    planes = np.frombuffer(raw, np.uint8).reshape(-1, many)
    out[: len(planes)] = planes
    return np.ascontiguousarray(out.T).view("<i8").reshape(-1)


def answered(stored: DataFrame, tree: DataFrame, known: Broadcast, common: Broadcast, bits: int, depth: int) -> DataFrame:
    """batch, bucket and, for each of the batch's questions in that bucket, in order, c and left; 0 for what is not in the tree."""

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch in opened(part):
                asked = questions(batch, batch.runs_in_tree(known.value, depth))
                asked = asked[~common.value.find(asked)[0]]
                told = dealt(asked, bits, asked=asked)
                yield told.append_column("batch", pa.array(np.full(told.num_rows, batch.number)))

    def meet(told: pa.Table, asks: pa.Table) -> pa.Table:
        part = Head.of(told)
        out: dict[str, list[bytes]] = {"c": [], "left": []}
        for raw in asks["asked"].to_pylist():
            asked = np.frombuffer(raw, np.uint64)
            hit, place = part.find(asked)
            for c, x in (("c", part.c), ("left", part.left)):
                answer = np.zeros(len(asked), np.int64)
                answer[hit] = x[place[hit]]
                out[c].append(_bytes(answer))
        return pa.table({"batch": asks["batch"], "bucket": asks["bucket"]} | {c: pa.array(x, pa.binary()) for c, x in out.items()})

    asks = stored.select(*COLUMNS).mapInArrow(ask, "bucket int, asked binary, batch long")
    rows = tree.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits).cast("int"))
    return settled(rows.groupBy("bucket").cogroup(asks.groupBy("bucket")).applyInArrow(meet, "batch long, bucket int, c binary, left binary"), "answers")


def scores(stored: DataFrame, tree: DataFrame, n: int, v: int, bits: int, depth: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of every text."""
    kind = stored.schema["doc_id"].dataType.elementType.simpleString()
    known = slot_sieve(tree.select("key").mapInArrow(lambda parts: slotted(part.column(0).to_numpy().view(np.uint64) for part in parts), "part int, low binary, high binary, counts binary"), 1, free=True)
    common = head(tree)
    answers = answered(stored, tree, known, common, bits, depth)

    def solve(own: pa.Table, told: pa.Table) -> pa.Table:
        batch = next(opened(own))
        found = list(batch.runs_in_tree(known.value, depth))
        asked = questions(batch, found)
        hit, place = common.value.find(asked)
        c, left = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        c[hit], left[hit] = common.value.c[place[hit]], common.value.left[place[hit]]
        turn = pa.array(np.argsort(told["bucket"].to_numpy()))
        many = np.diff(edges(asked[~hit], bits))
        many = many[many > 0].tolist()
        if many:
            c[~hit], left[~hit] = (np.concatenate([_numbers(raw, k) for raw, k in zip(told[name].take(turn).to_pylist(), many, strict=True)]) for name in ("c", "left"))
        place = np.searchsorted(asked, batch.words)[batch.place]
        count = c[place]
        p = (count + 0.5) / (n + 0.5 * (v + 1))
        base = np.log10(p)
        last = np.arange(len(place))
        for k, (at, keys) in enumerate(found, 1):
            # `place` and `last`: where runs of k words that may be in the tree have their answers, and where they end.
            state = left[place] > 0
            ended, place = last[state] + 1, place[state]
            inside = ended < len(p)
            ended, place = ended[inside], place[inside]
            inside = batch.text[ended] == batch.text[ended - k]
            ended, place = ended[inside], place[inside]
            entry = places(asked, keys)
            seen = np.zeros(len(p), np.int64)
            seen[at] = c[entry]
            p[ended] = (seen[ended] + (left[place] - 1 + STRENGTH) * p[ended]) / (c[place] + STRENGTH)
            last, place = at, entry
        many = len(batch.doc_id)
        sums = lambda x: pa.array(np.bincount(batch.text, x, many))
        whole = lambda x: pa.array(np.bincount(batch.text[x], minlength=many).astype(np.int64))
        return pa.table({"doc_id": batch.doc_id, "held_out": pa.array(batch.held), "n_tokens": whole(slice(None)), "n_known": whole(count > 0), "base_score": sums(base), "score": sums(np.log10(p))})

    return stored.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(solve, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score(own: DataFrame, tokens, depth: int) -> tuple[DataFrame, int]:
    """`scores` of a table of doc_id, held_out and text, and the number of training tokens."""
    stored = settled(batched(own, tokens), "batches")
    many = stored.agg(F.sum(F.expr("aggregate(size, 0L, (a, x) -> a + x)"))).first()[0] or 0
    bits = min(max(2, math.ceil(many / BUCKET).bit_length()), 20)
    words, n, v = count_words(stored, bits)
    return scores(stored, grow(stored, words, n, v, bits, depth), n, v, bits, depth), n
