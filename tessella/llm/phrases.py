"""Phrases of words that stand together more often than by chance, by suffix-sigma (operator 12).

Words are told apart by 64-bit keys of language and word. A first pass counts all words; only those that occur `least`
times can stand in a candidate, and a second pass counts pairs of these by slot, so two sieves of fixed size cut pieces at all other words and pairs. From every word that is left starts one
suffix of up to `max_words` words. Suffixes travel as bytes, two for each of the 65,535 commonest words (whose keys all
tasks get) and ten for others, and are dealt out by language and first word - split by second word, so that no common
word stays in one task. Each task sorts its suffixes in reverse order and counts all prefixes with one stack: the open prefixes of the
last suffix, one for each length. Single words have their counts from the first pass.

Parts of candidates occur as often as these or more, so they are found among the same counts: cuts are joined to them by the
bytes of their keys. A candidate's own contiguous parts are exploded to look up what longer ones say about it. Words of
candidates come back to their keys in a last pass; should two words of the text share a key there, all is done again with other keys.

A null text has no words, a null lang is `und`. Repeated rows count each time. Ties are settled by the phrase. Very long texts
are held whole by one task, with some 30 bytes of memory for each byte; a piece of any length makes one suffix a word. Extra
columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from tessella.llm.sieve import counted, often, passes, salts, sieve, slot_sieve, slotted
from tessella.llm.stage import written
from tessella.llm.textblock import BASE, LOWER, Block, blocks, mix, spans_hash

MAX_WORDS, LEAST, FIRST = 5, 100, 2000
#: Words with a code of two bytes.
CODES = 0xFFFF
#: Pairs pass the sieve from this part of the least count on: what is sent grows more evenly with the corpus than if pairs came in at the least count itself.
PAIR_PART = 10
#: Suffixes that a task holds before it sends them on.
FLUSH = 1 << 20

_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _BREAKS.copy()
_APART[[0x20, 0x09]] = True


@dataclass(frozen=True)
class Keying:
    """How words become keys; another seed gives others."""

    seed: int = 0
    bits: int = 64

    def keys(self, hashes: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Keys of words by language; never 0."""
        with np.errstate(over="ignore"):
            whole = mix(hashes ^ mix(salt + np.uint64(self.seed)))
        return np.maximum(whole >> np.uint64(64 - self.bits), np.uint64(1))


@dataclass
class Words:
    """The words of a block in order."""

    keys: np.ndarray
    piece: np.ndarray  # different for neighbours that no phrase joins
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _words(block: Block, salt: np.ndarray, keying: Keying) -> Words:
    starts, ends, bounds = block.words(_APART)
    text = np.repeat(np.arange(len(block)), np.diff(bounds))
    keys = keying.keys(spans_hash(LOWER[block.data], starts, ends, salt=keying.seed), salt[text])
    broken = np.concatenate([[0], np.cumsum(_BREAKS[block.data])])[starts] if len(starts) else starts
    return Words(keys, broken + text, text, starts, ends)


def _total_key(salt: np.ndarray) -> np.ndarray:
    """The key under which all words of a language are counted."""
    return mix(mix(salt) ^ BASE)


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def _blocks(batches: Iterator[pa.RecordBatch], keying: Keying) -> Iterator[tuple[Block, pa.RecordBatch, Words, np.ndarray]]:
    """Blocks with their rows, words, and the language salt of each text."""
    for batch in batches:
        lang, salt = salts(batch.column(0))
        for block in blocks(batch.column(1)):
            own = salt[lang[block.first : block.first + len(block)]]
            yield block, batch.slice(block.first, len(block)), _words(block, own, keying), own


def word_counts(own: DataFrame, least: int, keying: Keying) -> DataFrame:
    """(k, c): words that occur `least` times or more in their language, and languages with so many words, by their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for _, _, words, salt in _blocks(batches, keying):
                yield np.unique(words.keys, return_counts=True)
                yield _total_key(salt), np.bincount(words.text, minlength=len(salt))

        return counted(keys())

    return often(own.mapInArrow(run, "k long, c long"), least)


def encoded(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of rows of keys (0: none, at the end only): two bytes for a key among `codes`, which are in order, else ten."""
    at = np.minimum(np.searchsorted(codes, keys), max(len(codes) - 1, 0))
    coded = (codes[at] == keys) if len(codes) else np.zeros(keys.shape, bool)
    size = np.where(keys == 0, 0, np.where(coded, 2, 10))
    ends = np.cumsum(size.ravel())
    place = (ends - size.ravel()).reshape(size.shape)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0xFF, np.uint8)
    out[place[coded]], out[place[coded] + 1] = at[coded] >> 8, at[coded] & 0xFF
    far = (keys != 0) & ~coded
    for b in range(8):
        out[place[far] + 2 + b] = (keys[far] >> np.uint64(56 - 8 * b)) & np.uint64(0xFF)
    return out, np.concatenate([[0], ends[keys.shape[1] - 1 :: keys.shape[1]]])


def decoded(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray, width: int) -> np.ndarray:
    """The rows of keys back from their bytes."""
    keys = np.zeros((len(offsets) - 1, width), np.uint64)
    at, ends = offsets[:-1].copy(), offsets[1:]
    for k in range(width):
        row = np.flatnonzero(at < ends)
        code = data[at[row]].astype(np.int64) << 8 | data[at[row] + 1]
        near = code < CODES
        keys[row[near], k] = codes[code[near]]
        for b in range(8):
            keys[row[~near], k] = keys[row[~near], k] << np.uint64(8) | data[at[row[~near]] + 2 + b].astype(np.uint64)
        at[row] += np.where(near, 2, 10)
    return keys


def _pairs(words: Words, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two good words follow each other in a piece, for all words but the last, and the keys of these pairs."""
    goes_on = good[:-1] & good[1:] & (words.piece[:-1] == words.piece[1:])
    at = np.flatnonzero(goes_on)
    return goes_on, mix(words.keys[at] * BASE + words.keys[at + 1])


def pair_slots(own: DataFrame, bits: Broadcast, keying: Keying) -> DataFrame:
    """Counts of pairs of good words by slot, for a sieve of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return slotted(_pairs(words, passes(bits.value, words.keys))[1] for _, _, words, _ in _blocks(batches, keying))

    return own.mapInArrow(run, "part int, low binary, high binary, counts binary")


def _suffixes(words: Words, good: np.ndarray, pairs: np.ndarray, width: int) -> np.ndarray:
    """Keys of the suffix of up to `width` good words from each good word that another one follows in a good pair, 0 where it ends."""
    if len(good) < 2:
        return np.zeros((0, width), np.uint64)
    goes_on, keys = _pairs(words, good)
    goes_on[goes_on] = passes(pairs, keys)
    stops = np.flatnonzero(np.append(~goes_on, True))
    starts = np.flatnonzero(goes_on)
    length = np.minimum(stops[np.searchsorted(stops, starts)] - starts + 1, width)
    out = np.zeros((len(starts), width), np.uint64)
    for k in range(width):
        on = length > k
        out[on, k] = words.keys[starts[on] + k]
    return out


def _summed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a matrix of keys and how often each occurs."""
    whole = rows[:, 0].copy()
    for k in range(1, rows.shape[1]):
        whole = mix(whole * BASE + rows[:, k])
    _, first, place, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    if (rows[first][place] != rows).any():  # two rows share a hash
        return np.unique(rows, axis=0, return_counts=True)
    return rows[first], count


def prefix_counts(own: DataFrame, bits: Broadcast, pairs: Broadcast, codes: Broadcast, max_words: int, least: int, keying: Keying) -> DataFrame:
    """phrase, the keys of two words or more as eight bytes each, and a, its occurrences, `least` or more."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            rows, count = _summed(np.concatenate(held))
            data, offsets = encoded(rows, codes.value)
            suffix = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
            return pa.RecordBatch.from_arrays([suffix.cast(pa.binary()), pa.array(count.astype(np.int64))], names=["suffix", "c"])

        for _, _, words, _ in _blocks(batches, keying):
            held.append(_suffixes(words, passes(bits.value, words.keys), pairs.value, max_words))
            if sum(map(len, held)) > FLUSH:
                yield flush()
                held = []
        if sum(map(len, held)):
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # For each length the prefix that is still open, and its count so far.
        stack: list[tuple[bytes, int]] = [(b"", 0)] * (max_words + 1)

        def closed(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int]]:
            suffix = batch.column(0).cast(pa.large_binary())
            _, places, raw = suffix.buffers()
            offsets = np.frombuffer(places, np.int64)[suffix.offset : suffix.offset + len(suffix) + 1]
            keys = decoded(np.frombuffer(raw, np.uint8), offsets, codes.value, max_words)
            counts = batch.column(1).to_numpy()
            for size in range(2, max_words + 1):
                rows = np.flatnonzero(keys[:, size - 1] != 0)
                if not len(rows):
                    continue
                own = keys[rows, :size]
                first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(1)]))
                sums = np.add.reduceat(counts[rows], first)
                names = own[first].astype(">u8")
                if names[0].tobytes() == stack[size][0]:
                    sums[0] += stack[size][1]
                else:
                    yield stack[size]
                for k in np.flatnonzero(sums[:-1] >= least):
                    yield names[k].tobytes(), int(sums[k])
                stack[size] = names[-1].tobytes(), int(sums[-1])

        def batch_of(found: list[tuple[bytes, int]]) -> pa.RecordBatch:
            found = [x for x in found if x[1] >= least]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.int64())], names=["phrase", "a"])

        for batch in batches:
            if batch.num_rows:
                yield batch_of(list(closed(batch)))
        yield batch_of(stack)

    suffixes = own.mapInArrow(send, "suffix binary, c long")
    # Four bytes: the first two words, or the first and the mark of a rare second one, or the mark of a rare first one and two bytes of it.
    dealt = suffixes.repartition(F.substring("suffix", 1, 4)).sortWithinPartitions(F.col("suffix").desc())
    return dealt.mapInArrow(count, "phrase binary, a long")


def _vocabulary(own: DataFrame, bits: Broadcast, keying: Keying) -> DataFrame:
    """k, lang, word and the language's total key of every word that passes the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for block, rows, words, salt in _blocks(batches, keying):
            fresh, first = np.unique(words.keys, return_index=True)
            new = passes(bits.value, fresh) & ~np.isin(fresh, seen)
            fresh, first = fresh[new], first[new]
            # What a task has sent last need not go again; two words of one key are both sent, from different texts or tasks.
            seen = fresh if len(seen) > FLUSH else np.union1d(seen, fresh)
            text = words.text[first]
            data = LOWER[block.data]
            told = [data[words.starts[i] : words.ends[i]].tobytes().decode() for i in first]
            columns = [pa.array(fresh.view(np.int64)), rows.column(0).take(pa.array(text)), pa.array(told, pa.string()), pa.array(_total_key(salt[text]).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "lang", "word", "total"])

    return own.mapInArrow(run, "k long, lang string, word string, total long").distinct()


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, first: int = FIRST, keying: Keying = Keying()) -> DataFrame:  # noqa: B008  frozen
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases."""
    own = _own(docs)
    counts = written(word_counts(own, least, keying), "words")
    bits = sieve(counts)
    # At most 65,535 keys of eight bytes.
    common = [r["k"] for r in counts.orderBy(F.col("c").desc(), "k").limit(CODES).select("k").collect()]
    codes = own.sparkSession.sparkContext.broadcast(np.sort(np.array(common, np.int64).view(np.uint64)))
    found = written(prefix_counts(own, bits, slot_sieve(pair_slots(own, bits, keying), max(1, least // PAIR_PART)), codes, max_words, least, keying), "phrases")
    used = written(found.select(F.explode(F.expr("transform(sequence(0, cast(length(phrase) / 8 as int) - 1), o -> substring(phrase, 8 * o + 1, 8))")).alias("one")).distinct().select(F.conv(F.hex("one"), 16, -10).cast("long").alias("k")), "used")
    vocabulary = written(_vocabulary(own, sieve(used), keying).join(used, "k", "left_semi"), "vocabulary", used)
    if not vocabulary.groupBy("k").agg(F.count(F.lit(1)).alias("words")).where("words > 1").isEmpty():
        return collocations(docs, max_words, least, first, Keying(keying.seed + 1))

    size = F.length("phrase") / 8
    one = counts.select(F.unhex(F.lpad(F.hex("k"), 16, "0")).alias("part"), F.col("c").alias("f"))
    parts = found.select(F.col("phrase").alias("part"), F.col("a").alias("f")).unionByName(one)
    cut = found.select("phrase", "a", F.explode(F.sequence(F.lit(1), (size - 1).cast("int"))).alias("k"))
    cut = cut.withColumns({"left": F.expr("substring(phrase, 1, 8 * k)"), "right": F.expr("substring(phrase, 8 * k + 1)")})
    cut = cut.join(parts.select(F.col("part").alias("left"), F.col("f").alias("l")), "left").join(parts.select(F.col("part").alias("right"), F.col("f").alias("r")), "right")
    head = vocabulary.join(counts.select(F.col("k").alias("total"), F.col("c").alias("n")), "total").select(F.unhex(F.lpad(F.hex("k"), 16, "0")).alias("head"), "lang", "n")
    cut = cut.withColumn("head", F.expr("substring(phrase, 1, 8)")).join(head, "head")
    exact = "cast((cast(a as decimal(18,0)) * cast(n as decimal(18,0))) as decimal(35,0)) * cast(1000 as decimal(4,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    best = cut.groupBy("phrase", "a", "lang", "n").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("best"))

    inner = "flatten(transform(sequence(2, m - 1), s -> transform(sequence(0, m - s), o -> substring(phrase, 8 * o + 1, 8 * s))))"
    longer = found.withColumn("m", size.cast("int")).where("m > 2").select(F.explode(F.expr(inner)).alias("phrase"), F.col("a").alias("longer")).groupBy("phrase").agg(F.max("longer").alias("longer"))
    left = best.join(longer, "phrase", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a")))

    word = vocabulary.select(F.unhex(F.lpad(F.hex("k"), 16, "0")).alias("one"), "word")
    each = left.select("phrase", F.posexplode(F.expr("transform(sequence(0, cast(length(phrase) / 8 as int) - 1), o -> substring(phrase, 8 * o + 1, 8))")).alias("at", "one")).join(word, "one")
    told = each.groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("told"))
    ranked = left.join(told, "phrase").select("lang", F.col("told").alias("phrase"), "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    # Spark keeps the first rows of each language in every task before it brings them together.
    return ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
with docs as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), pieces as (
  select lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) as piece from docs
), words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), totals as (
  select lang, sum(len(w))::hugeint as n from words group by lang
), grams as (
  select lang, w[i:i + m - 1] as g from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from words, (select unnest([1, 2, 3, 4, 5]) as m) where len(w) >= m)
), counts as (
  select lang, g, count(*)::hugeint as f from grams group by all having count(*) >= 100
), cuts as (
  select lang, g, f as a, k, g[1:k] as lg, g[k + 1:] as rg from (select *, unnest(range(1, len(g))) as k from counts where len(g) >= 2)
), scored as (
  select c.lang, c.g, c.a, c.k, l.f as l, r.f as r, t.n, (1000::hugeint * c.a * t.n) // (l.f * r.f) as score
  from cuts c join counts l on l.lang = c.lang and l.g = c.lg join counts r on r.lang = c.lang and r.g = c.rg join totals t on t.lang = c.lang
), best as (
  select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1
), inner_parts as (
  select lang, f, g[o:o + s - 1] as g from (select lang, g, f, s, unnest(range(1, len(g) - s + 2)) as o from counts, (select unnest([2, 3, 4]) as s) where len(g) > s)
), longer as (
  select lang, g, max(f) as f from inner_parts group by all
), left_over as (
  select b.*, array_to_string(b.g, ' ') as phrase from best b left join longer x on x.lang = b.lang and x.g = b.g where x.f is null or 100 * x.f < 100 * b.a
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from left_over
)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
"""
