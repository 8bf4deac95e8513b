"""Language-model scores by a probabilistic suffix tree over words (operator 7).

`score` uses the whole tree, in distributed tables (`suffixtree`): all words are symbols, and every context counts.
The rest of this text is about `bounded_score`, whose tree fits every task.

Symbols are the words that make up at least `SYMBOL_SHARE` of the training tokens, and one class for all others. As
usual for such trees, a context - a run of up to `depth` symbols of which none is the class - is a candidate if its
probability is at least `CONTEXT_SHARE`. It becomes a state if its suffix is one and its next-symbol distribution
diverges from its suffix's: the log-likelihood that it gains on its own tokens, each predicted from all the others,
must be positive by `SIGNIFICANCE` standard deviations. Leaving each token out makes contexts whose successors are
drawn by chance lose, however many successors they have. A state's distribution is its counts, smoothed by its suffix's
distribution; the root's is the base estimate, in which all unseen words are one word. Within the class, words keep
their shares of the root's. So the score is the log-probability of the text under a distribution over the training
words, the end and one unseen word. A token is scored by the longest state that ends before it.

Probability thresholds bound what every task holds of the tree; the word counts grow with the corpus, stay a
distributed table and meet the rarer words of the texts in a join.

Texts are lower-cased in A-Z; tokens are words and one end. A null text is empty and scores its end. Texts of
the held-out fold teach nothing; a null doc_id counts as an empty text in the fold. Repeated rows count, and
come back, each time. Words of equal counts are ranked by hash; no result depends on the order of rows. A task holds a
text whole, with about 10 bytes of memory for each byte of the longest and 60 for each of its words. Extra columns are ignored; an empty table
gives an empty result. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.llm import suffixtree
from tessella.llm.langid import fold
from tessella.llm.stage import few_rows, written
from tessella.llm.textblock import LOWER, Block, blocks, mix, spans_hash

END = np.uint64(0x5EED0F7E57E4D000)
FLUSH = 1_000_000

#: Shares of the training tokens; their inverses bound the sizes of the tables that reach every task.
KNOWN_SHARE = 2e-6  # words whose counts reach every task
SYMBOL_SHARE = 2e-5  # at most 50,000 symbols, so that one fits two bytes
CONTEXT_SHARE = 2e-4
ENTRY_SHARE = 5e-7
DEPTH = 4
LEAST_COUNT, STRENGTH, SIGNIFICANCE = suffixtree.LEAST_COUNT, suffixtree.STRENGTH, suffixtree.SIGNIFICANCE


class HashIndex:
    """Places of 64-bit keys in a table, by direct addressing on their upper bits."""

    def __init__(self, keys: np.ndarray) -> None:
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Place of each asked key, -1 if absent."""
        out = np.full(len(asked), -1, np.int64)
        if not len(self.keys):
            return out
        top = (asked >> self.shift).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        open_ = np.flatnonzero(at < end)
        at, end = at[open_], end[open_]
        while len(open_):
            hit = self.keys[at] == asked[open_]
            out[open_[hit]] = self.order[at[hit]]
            at = at + 1
            go = ~hit & (at < end)
            open_, at, end = open_[go], at[go], end[go]
        return out


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a block, each text's end after its words, and the text of each token."""
    starts, ends, bounds = block.words()
    n = len(block)
    text = np.repeat(np.arange(n), np.diff(bounds))
    out = np.full(len(starts) + n, END, np.uint64)
    out[np.arange(len(starts)) + text] = spans_hash(LOWER[block.data], starts, ends)
    return out, np.repeat(np.arange(n), np.diff(bounds) + 1)


def _totals(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counts of all keys, summed within the task as far as memory allows."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        keys, count = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(count.astype(np.int64))], names=["w", "c"])

    for found in arrays:
        held.append(found)
        size += len(found)
        if size > FLUSH:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _runs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """Symbols of consecutive texts of a column of stored ones, each symbol's text, and their rows."""
    for block in blocks(column):
        yield block.data.view("<u2").astype(np.int64), np.repeat(np.arange(len(block)), np.diff(block.offsets) // 2), slice(block.first, block.first + len(block))


@dataclass
class Level:
    """States of one depth: their contexts' keys, totals, suffix states, and (state, symbol) entries."""

    contexts: HashIndex
    total: np.ndarray
    rest: np.ndarray  # weight left to the suffix's distribution
    parent: np.ndarray  # state of the next shorter depth, -1: the root
    entries: HashIndex
    count: np.ndarray

    def next(self, state: np.ndarray, symbol: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities of symbols given states, from those given their suffixes."""
        entry = self.entries.find(entry_key(state, symbol))
        seen = np.where(entry >= 0, self.count[np.maximum(entry, 0)], 0) if len(self.count) else np.zeros(len(state))
        return (seen + self.rest[state] * p) / (self.total[state] + STRENGTH)


@dataclass
class Model:
    n: int  # training tokens
    v: int  # different ones
    known: HashIndex  # most frequent words
    known_count: np.ndarray
    symbols: int  # the first so many of them are symbols
    levels: list[Level] = field(default_factory=list)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))

    @property
    def root_of_symbols(self) -> np.ndarray:
        """Root probabilities of the symbols and, last, of the class of all other words."""
        p = 10.0 ** self.base(self.known_count[: self.symbols])
        return np.append(p, max(1 - p.sum(), 1e-12))

    def symbol_of(self, place: np.ndarray) -> np.ndarray:
        return np.where((place >= 0) & (place < self.symbols), place, self.symbols)

    def contexts_at(self, symbol: np.ndarray, text: np.ndarray, depth: int) -> np.ndarray:
        """Key of the `depth` symbols before each token, 0 where the text has fewer or one is no symbol."""
        key = np.zeros(len(symbol), np.uint64)
        if len(symbol) <= depth:
            return key
        inside = text[depth:] == text[:-depth]
        run = np.full(len(symbol) - depth, depth, np.uint64)
        for k in range(1, depth + 1):
            before = symbol[depth - k : len(symbol) - k]
            inside &= before < self.symbols
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + before.astype(np.uint64) + np.uint64(1))
        key[depth:][inside] = run[inside]
        return key

    def state_probabilities(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Of symbols, given states of the last level; -1 is the root."""
        chain = []
        for level in reversed(self.levels):
            chain.append(state)
            state = np.where(state >= 0, level.parent[np.maximum(state, 0)], -1)
        p = self.root_of_symbols[symbol]
        for level, s in zip(self.levels, reversed(chain), strict=True):
            at = np.flatnonzero(s >= 0)
            p[at] = level.next(s[at], symbol[at], p[at])
        return p

    def probabilities(self, symbol: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Of each token's symbol, given the longest state before it."""
        p = self.root_of_symbols[symbol]
        for depth, level in enumerate(self.levels, 1):
            found = level.contexts.find(self.contexts_at(symbol, text, depth))
            at = np.flatnonzero(found >= 0)
            p[at] = level.next(found[at], symbol[at], p[at])
        return p


def entry_key(state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix((state.astype(np.uint64) << np.uint64(32)) | symbol.astype(np.uint64))


def word_counts(training: DataFrame) -> tuple[DataFrame, int, int]:
    """The table of all words' counts (w, c) of a table of texts (one column), their sum and the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _totals(tokens(block)[0] for batch in batches for block in blocks(batch.column(0)))

    words = written(training.mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "words")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    return words, sums["n"], sums["v"]


def count_words(training: DataFrame) -> tuple[Model, DataFrame]:
    """The root of the bounded model of a table of texts (one column), and the table of all words' counts."""
    words, n, v = word_counts(training)
    # At most 1 / KNOWN_SHARE words.
    top = words.where(F.col("c") >= max(n * KNOWN_SHARE, LEAST_COUNT)).toArrow().to_pandas().sort_values(["c", "w"], ascending=[False, True])
    count = top["c"].to_numpy(np.int64)
    return Model(n, v, HashIndex(top["w"].to_numpy(np.int64).view(np.uint64)), count, int((count >= max(n * SYMBOL_SHARE, LEAST_COUNT)).sum())), words


def grow(stored: DataFrame, model: Model, depth: int = DEPTH) -> Model:
    """The model with its states, level by level, from a table of the training texts' symbols (one column)."""
    for k in range(1, depth + 1):
        level = _next_level(stored, model, k)
        if level is None:
            break
        model.levels.append(level)
    return model


def _next_level(stored: DataFrame, model: Model, depth: int) -> Level | None:
    """States of the next depth from two passes over the symbols: frequent contexts, then what follows them."""
    spark = stored.sparkSession
    least = max(model.n * CONTEXT_SHARE, LEAST_COUNT)
    shared = spark.sparkContext.broadcast(model)

    def context_keys(symbol: np.ndarray, text: np.ndarray) -> np.ndarray:
        m = shared.value
        keys = m.contexts_at(symbol, text, depth)
        # Only an extension of a state, or of the root, can be a candidate.
        if m.levels:
            keys = np.where(m.levels[-1].contexts.find(m.contexts_at(symbol, text, depth - 1)) >= 0, keys, np.uint64(0))
        elif depth == 1:
            often = np.append(m.known_count[: m.symbols] >= least, False)
            keys[1:] = np.where(often[symbol[:-1]], keys[1:], np.uint64(0))
        return keys[keys != 0]

    counted = stored.mapInArrow(lambda batches: _totals(context_keys(s, t) for b in batches for s, t, _ in _runs(b.column(0))), "w long, c long")
    # At most 1 / CONTEXT_SHARE contexts.
    found = counted.groupBy("w").agg(F.sum("c").alias("c")).where(F.col("c") >= least).toArrow().to_pandas().sort_values("w")
    if not len(found):
        return None
    contexts, total = HashIndex(found["w"].to_numpy(np.int64).view(np.uint64)), found["c"].to_numpy(np.float64)
    shared_contexts = spark.sparkContext.broadcast(contexts)

    def pairs_of(symbol: np.ndarray, text: np.ndarray) -> np.ndarray:
        m = shared.value
        state = shared_contexts.value.find(m.contexts_at(symbol, text, depth))
        shorter = np.full(len(symbol), -1, np.int64)
        if m.levels:
            shorter = m.levels[-1].contexts.find(m.contexts_at(symbol, text, depth - 1))
        at = np.flatnonzero(state >= 0)
        # The suffix's state rides along in the upper bits: it is the same for every occurrence of a context.
        return ((shorter[at] + 1).astype(np.uint64) << np.uint64(48)) | (state[at].astype(np.uint64) << np.uint64(32)) | symbol[at].astype(np.uint64)

    pairs = stored.mapInArrow(lambda batches: _totals(pairs_of(s, t) for b in batches for s, t, _ in _runs(b.column(0))), "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    # At most 1 / ENTRY_SHARE entries.
    least_entry = max(model.n * ENTRY_SHARE, LEAST_COUNT)
    kept = pairs.where(F.col("c") >= least_entry).toArrow().to_pandas().sort_values("w")
    if not len(kept):
        return None
    packed = kept["w"].to_numpy(np.int64).view(np.uint64)
    state, symbol = ((packed >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    shorter = (packed >> np.uint64(48)).astype(np.int64) - 1
    count = kept["c"].to_numpy(np.float64)
    parent = np.full(len(total), -1, np.int64)
    parent[state] = shorter
    before = model.state_probabilities(shorter, symbol)
    rest = total - np.bincount(state, count, len(total)) + STRENGTH
    keep = diverges(state, count, total, rest, before, least_entry)
    if not keep.any():
        return None
    number = np.cumsum(keep) - 1
    e = keep[state]
    return Level(HashIndex(contexts_keys(contexts)[keep]), total[keep], rest[keep], parent[keep], HashIndex(entry_key(number[state[e]], symbol[e])), count[e])


def diverges(state: np.ndarray, count: np.ndarray, total: np.ndarray, rest: np.ndarray, before: np.ndarray, least: float) -> np.ndarray:
    """For each context, from its entries (state, count, suffix's probability): does it predict its own tokens, each from all others, surely better than its suffix?

    Without one of its tokens an entry at the threshold would be part of the rest.
    """
    less = total - 1 + STRENGTH
    stays = count - 1 >= least
    alone = np.where(stays, (count - 1) / before + rest[state], rest[state] + count - 1) / less[state]
    gain = np.log(alone)
    dropped = rest - STRENGTH
    lost = np.log((STRENGTH + np.maximum(dropped - 1, 0)) / less)
    sums = np.bincount(state, count * gain, len(total)) + dropped * lost
    squares = np.bincount(state, count * gain**2, len(total)) + dropped * lost**2
    return sums > SIGNIFICANCE * np.sqrt(squares)


def contexts_keys(index: HashIndex) -> np.ndarray:
    """The keys of an index in the order in which it was given them."""
    out = np.zeros_like(index.keys)
    out[index.order] = index.keys
    return out


def tell_batches(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text's tokens, symbols, share of the base score from known words, and hashes of its rarer words, whose counts the model lacks."""
    for batch in batches:
        for block in blocks(batch.column(2)):
            n = len(block)
            hashes, text = tokens(block)
            place = model.known.find(hashes)
            known = place >= 0
            count = np.where(known, model.known_count[np.maximum(place, 0)], 0) if len(model.known_count) else np.zeros(len(place), np.int64)
            base = np.bincount(text[known], model.base(count[known]), n)
            rare = np.flatnonzero(~known)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[rare], minlength=n))]).astype(np.int32)), pa.array(hashes[rare].view(np.int64)))
            bounds = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]) * 2
            symbols = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(model.symbol_of(place).astype("<u2").tobytes())])
            row = slice(block.first, block.first + n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[row], batch.column(1)[row], pa.array(np.bincount(text, minlength=n)), pa.array(np.bincount(text[known], minlength=n)), pa.array(base), lists, symbols], names=["doc_id", "held_out", "n_tokens", "_known", "_base", "_rare", "_symbols"]
            )


def gain_batches(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By row number, what the states add to every text's base score."""
    root = np.log10(model.root_of_symbols)
    for batch in batches:
        for symbol, text, row in _runs(batch.column(1)):
            shift = np.bincount(text, np.log10(model.probabilities(symbol, text)) - root[symbol], row.stop - row.start)
            yield pa.RecordBatch.from_arrays([batch.column(0)[row], pa.array(shift)], names=["_row", "_shift"])


def score(docs: DataFrame, folds: int = 5, held: int = 1, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per input row, by the whole tree."""
    few_rows(docs.sparkSession)
    own = docs.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), F.col("text").cast("string").alias("_text"))
    told, n = suffixtree.score(own, tokens, depth)
    return told.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def bounded_score(docs: DataFrame, folds: int = 5, held: int = 1, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per input row, by the tree that fits a task."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), F.col("text").cast("string").alias("_text"))
    model, words = count_words(own.where(~F.col("held_out")).select("_text"))
    root = spark.sparkContext.broadcast(model)
    parts = own.mapInArrow(lambda batches: tell_batches(root.value, batches), f"doc_id {kind}, held_out boolean, n_tokens long, _known long, _base double, _rare array<long>, _symbols binary")
    # Row numbers hold from here on: the table is written once.
    parts = written(parts.withColumn("_row", F.monotonically_increasing_id()), "parts")
    model = grow(parts.where(~F.col("held_out")).select("_symbols"), model, depth)
    tree = spark.sparkContext.broadcast(model)
    shifts = parts.select("_row", "_symbols").mapInArrow(lambda batches: gain_batches(tree.value, batches), "_row long, _shift double")

    rare = parts.select("_row", F.explode("_rare").alias("w")).join(words, "w", "left").select("_row", F.coalesce("c", F.lit(0)).alias("c"))
    c = F.col("c")
    log_base = F.log10((c + 0.5) / F.lit(float(model.n + 0.5 * (model.v + 1))))
    sums = rare.groupBy("_row").agg(F.sum((c > 0).cast("long")).alias("_more"), F.sum(log_base).alias("_b"))
    told = parts.drop("_rare", "_symbols").join(shifts, "_row").join(sums, "_row", "left")
    base = F.col("_base") + F.coalesce("_b", F.lit(0.0))
    return told.select("doc_id", "held_out", "n_tokens", (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("_shift")).alias("score"))
