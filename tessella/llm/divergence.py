"""Audit of how far sources diverge in their words (operator 13).

Terms are runs of letters. A first pass counts the documents of each (language, term) by a key, for a sieve of fixed size;
the second pass counts what passes it by language, source and term, and the terms in enough documents are kept, exactly.

Sources are compared over all kept terms of their language, but only terms that occur are touched. With p the smoothed
share of a term and p0 that of an absent one, the sum over all terms of f(p, q) is V f(p0, q0), plus f(p, q0) - f(p0, q0)
for the terms of the one side, taken from a histogram of its counts, plus the same for the other side, plus a
correction for the terms of both. Corrections are summed within blocks of terms, so that no pair leaves its task alone.

A group's highest terms are found by radix selection: histograms over ten bits of the values at a time, made of
all groups at once, lead to the kth value. Terms that tie there are told apart by their UTF-8 bytes in the same way: two more bytes
a round behind what all still have in common, until few are left in the bin. No group is ever sorted whole.

Nulls in text, lang and source count as ''. Repeated rows are documents of their own. Ties are settled by item. Very long
texts and terms are held whole by one task. Extra columns, whatever their names, are ignored. An empty table gives an empty result; a
group without terms, or a language without kept ones, still gives its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.llm.sieve import counted, often, passes, salts, sieve
from tessella.llm.stage import written
from tessella.llm.textblock import LOWER, Block, blocks, mix, spans_hash

LEAST_DOCS = 10
TOP = 10
#: Rows of (term, source) that a task compares at once, about.
TERM_ROWS = 200_000
#: Bits of the values that one histogram tells apart, and bits of all values: none is above 10**9 + 1.
DIGIT, VALUE_BITS = 10, 30
#: Ties of a group that are ranked as they are.
TIE_ROWS = 1000
BLOCK_BYTES = 1 << 21
#: Rows of counts that a task holds before it sends them on.
FLUSH_ROWS = 1 << 20

_APART = np.ones(256, bool)
_APART[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _by_text(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of a text and one of its terms: the term's hash, start and end of its first place, the text, and the count."""
    starts, ends, bounds = block.words(_APART)
    text = np.repeat(np.arange(len(block)), np.diff(bounds))
    hashes = spans_hash(LOWER[block.data], starts, ends)
    order = np.lexsort((text, hashes))
    hashes, text = hashes[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])) if len(order) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(order)))
    return hashes[first], starts[order[first]], ends[order[first]], text[first], count


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _documents_by_key(own: DataFrame) -> DataFrame:
    """(k, c): in how many documents of its language a term occurs, by the key of both; to be summed."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            lang, salt = salts(batch.column(0))
            for block in blocks(batch.column(1), BLOCK_BYTES):
                found = _by_text(block)
                key = found[0] ^ salt[lang[block.first + found[3]]]
                yield np.unique(key, return_counts=True)

    return own.select("lang", "text").mapInArrow(lambda batches: counted(keys(batches)), "k long, c long")


def term_counts(own: DataFrame, least: int) -> DataFrame:
    """lang, source, term, its occurrences n and its documents docs, of terms that may occur in `least` documents of the language."""
    bits = sieve(often(_documents_by_key(own), least))
    names = ["lang", "source", "term", "n", "docs"]

    def of_block(block: Block, group: np.ndarray, lang_salt: np.ndarray, groups: pa.Table) -> pa.Table:
        hashes, starts, ends, text, count = _by_text(block)
        good = np.flatnonzero(passes(bits.value, hashes ^ lang_salt[text]))
        hashes, starts, ends, text, count = (x[good] for x in (hashes, starts, ends, text, count))
        order = np.lexsort((group[text], hashes))
        hashes, own_group, count = hashes[order], group[text[order]], count[order]
        first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (own_group[1:] != own_group[:-1])])) if len(order) else np.zeros(0, np.int64)
        data = LOWER[block.data]
        at = order[first]
        size = ends[at] - starts[at]
        offsets = np.concatenate([[0], np.cumsum(size)])
        flat = data[np.arange(offsets[-1]) + np.repeat(starts[at] - offsets[:-1], size)]
        terms = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())).cast(pa.string())
        told = groups.take(pa.array(own_group[first]))
        n = np.add.reduceat(count, first) if len(first) else count
        return pa.table([*told.columns, terms, pa.array(n.astype(np.int64)), pa.array(np.diff(np.append(first, len(order))).astype(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush() -> list[pa.RecordBatch]:
            summed = pa.concat_tables(held).group_by(names[:3], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
            return summed.rename_columns(names).to_batches(max_chunksize=50_000)

        for batch in batches:
            lang, salt = salts(batch.column(0))
            source = batch.column(1).dictionary_encode()
            pair = lang * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
            _, rows, group = np.unique(pair, return_index=True, return_inverse=True)
            groups = pa.Table.from_batches([batch.select([0, 1])]).take(pa.array(rows))
            for block in blocks(batch.column(2), BLOCK_BYTES):
                mine = slice(block.first, block.first + len(block))
                held.append(of_block(block, group[mine], salt[lang[mine]], groups))
                if sum(t.num_rows for t in held) > FLUSH_ROWS:
                    yield from flush()
                    held = []
        if held:
            yield from flush()

    return own.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str | Column, total: str | Column, kept: str | Column) -> Column:
    """1 + floor(10**9 (n + 2) / (total + 2 kept)), exactly; null if there is nothing to share."""
    whole = [(F.col(x) if isinstance(x, str) else x).cast("decimal(19,0)") for x in (n, total, kept)]
    size = (whole[1] + 2 * whole[2]).cast("decimal(20,0)")
    return F.when(size > 0, 1 + F.call_function("div", (F.lit(10**9).cast("decimal(10,0)") * (whole[0] + 2).cast("decimal(20,0)")).cast("decimal(30,0)"), size)).cast("long")


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); at most 10**9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _one_sided(told: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item and one: what the source's own terms add to its divergence from item, beyond absent terms."""
    counts = told.groupBy("lang", "source", "p0", "p").agg(F.count(F.lit(1)).alias("many"))
    own = counts.groupBy("lang", "source", "p0").agg(F.collect_list("p").alias("ps"), F.collect_list("many").alias("many"))
    # Sources with the same p0 count as one here.
    others = groups.select("lang", F.col("p0").alias("q0")).distinct()
    pairs = own.join(others, "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            p0, q0 = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            for k in range(batch.num_rows):
                p, many = batch.column(3)[k].values.to_numpy(), batch.column(4)[k].values.to_numpy()
                out[k] = (many * (_apart(p, q0[k]) - _apart(p0[k], q0[k]))).sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(5), pa.array(out)], names=["lang", "source", "q0", "one"])

    return pairs.select("lang", "source", "p0", "ps", "many", "q0").mapInArrow(run, "lang string, source string, q0 long, one long")


def _two_sided(told: DataFrame) -> DataFrame:
    """lang, low, high (two sources in order) and both: the correction for the terms that both have."""
    n = told.count()
    placed = told.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(max(1, n // TERM_ROWS))).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        names = table["source"].combine_chunks().dictionary_encode()
        if isinstance(names, pa.ChunkedArray):
            names = names.combine_chunks()
        rank = np.argsort(np.argsort(np.array([x.encode() for x in names.dictionary.to_pylist()], object)))
        source = rank[names.indices.to_numpy(zero_copy_only=False)]
        term = table["term"].combine_chunks().dictionary_encode()
        term = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((source, term))
        source, term = source[order], term[order]
        p, p0 = (table[c].to_numpy()[order] for c in ("p", "p0"))
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        width = len(rank)
        for step in range(1, width):
            at = np.flatnonzero(term[step:] == term[:-step])
            if not len(at):
                break
            a, b = at, at + step
            added = _apart(p[a], p[b]) - _apart(p[a], p0[b]) - _apart(p0[a], p[b]) + _apart(p0[a], p0[b])
            keys, sums = np.concatenate([keys, source[a] * width + source[b]]), np.concatenate([sums, added])
            if len(keys) > 4 * TERM_ROWS or step == width - 1:
                keys, sums = _summed(keys, sums)
        keys, sums = _summed(keys, sums)
        by_rank = pa.array(np.argsort(rank))
        ordered = names.dictionary.take(by_rank)
        return pa.table({"lang": table["lang"].combine_chunks().take(pa.array(np.zeros(len(keys), np.int64))), "low": ordered.take(pa.array(keys // width)), "high": ordered.take(pa.array(keys % width)), "both": pa.array(sums)})

    parts = placed.select("lang", "block", "term", "source", "p", "p0").groupBy("lang", "block").applyInArrow(run, "lang string, low string, high string, both long")
    return parts.groupBy("lang", "low", "high").agg(F.sum("both").alias("both"))


def _summed(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, sums
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], sums[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(sums, first)


def highest(rows: DataFrame, k: int, tie_rows: int = TIE_ROWS) -> DataFrame:
    """lang, source, item, value and rank of each (lang, source)'s k rows of highest value, ties by UTF-8 bytes; `rows` must be written, its values 0 to 2**30 - 1."""
    group = ["lang", "source"]
    down = Window.partitionBy(*group).orderBy(F.col("bin").desc())
    state = None
    for shift in range(VALUE_BITS - DIGIT, -1, -DIGIT):
        digit = F.shiftright("value", shift).bitwiseAND((1 << DIGIT) - 1)
        if state is None:
            open_ = rows.withColumns({"prefix": F.lit(0).cast("long"), "above": F.lit(0).cast("long")})
        else:
            open_ = rows.join(state, group).where(F.shiftright("value", shift + DIGIT) == F.col("prefix"))
        bins = open_.groupBy(*group, "prefix", "above", digit.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        # At most 1024 bins a group.
        reached = bins.withColumn("upto", F.col("above") + F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        edge = reached.where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k))
        state = written(edge.select(*group, (F.shiftleft("prefix", DIGIT) + F.col("bin")).alias("prefix"), (F.col("upto") - F.col("n")).alias("above"), "n"), "digits")
        state, sizes = state.drop("n"), state
    # Of each group with k rows or more: the kth value, how many of its rows are needed, the first bytes of the last of them, and how many begin so.
    state = sizes.select(*group, F.col("prefix").alias("kth"), (k - F.col("above")).alias("need"), F.unhex(F.lit("")).alias("upto"), "n")
    while not (open_ := state.where((F.col("n") > tie_rows) & (F.col("n") > F.col("need")))).isEmpty():
        state = written(_closer(rows, open_, group).unionByName(state.where((F.col("n") <= tie_rows) | (F.col("n") <= F.col("need")))), "ties")
    held = rows.join(state, group, "left")
    begins = F.substring(F.col("item").cast("binary"), F.lit(1), F.length("upto"))
    near = held.where(F.col("kth").isNull() | (F.col("value") > F.col("kth")) | ((F.col("value") == F.col("kth")) & (begins <= F.col("upto"))))
    # At most k + tie_rows rows a group.
    order = Window.partitionBy(*group).orderBy(F.col("value").desc(), "item")
    return near.select(*group, "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def _closer(rows: DataFrame, open_: DataFrame, group: list[str]) -> DataFrame:
    """One round among the ties of open groups: two more bytes behind those that all ties in the bin have in common."""
    raw = F.col("item").cast("binary")
    ties = rows.join(open_, group).where((F.col("value") == F.col("kth")) & (F.substring(raw, F.lit(1), F.length("upto")) == F.col("upto"))).select(*group, "kth", "need", raw.alias("raw"))
    # Binary minimum and maximum: bytes of strings are in the order of strings.
    ends = ties.groupBy(*group).agg(F.min("raw").alias("a"), F.max("raw").alias("b"))
    common = F.expr("aggregate(sequence(1, greatest(1, least(length(a), length(b)))), 0, (s, i) -> if(s = i - 1 and i <= length(a) and substring(a, i, 1) = substring(b, i, 1), i, s))")
    told = ties.join(ends.select(*group, common.alias("common")), group)
    bins = told.groupBy(*group, "kth", "need", F.substring(F.col("raw"), F.lit(1), F.col("common") + 2).alias("upto")).agg(F.count(F.lit(1)).alias("n"))
    rising = Window.partitionBy(*group).orderBy("upto").rowsBetween(Window.unboundedPreceding, 0)
    reached = bins.withColumn("sum", F.sum("n").over(rising))  # at most 65,793 bins a group
    edge = reached.where((F.col("sum") >= F.col("need")) & (F.col("sum") - F.col("n") < F.col("need")))
    return edge.select(*group, "kth", (F.col("need") - (F.col("sum") - F.col("n"))).alias("need"), "upto", "n")


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, tie_rows: int = TIE_ROWS) -> DataFrame:
    """lang, source, part, item, value and rank: every other source of the language by its divergence, and the source's most typical terms."""
    own = _own(docs)
    counts = written(term_counts(own, least), "terms")
    # A list has one entry a source.
    of_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.collect_list(F.struct("source", "n")).alias("held"))
    kept = written(of_term.where(F.col("docs") >= least).select("lang", "term", "n_lang", F.explode("held").alias("h")).select("lang", "term", "n_lang", F.col("h.source").alias("source"), F.col("h.n").alias("n")), "kept", counts)
    langs = kept.groupBy("lang").agg(F.sum("n").alias("all_lang"), F.count_distinct("term").alias("v"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("all"))
    groups = own.select("lang", "source").distinct().join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("all_lang", "v", "all")))
    groups = written(groups.withColumn("p0", share(F.lit(0), "all", "v")), "groups")
    told = written(kept.join(groups, ["lang", "source"]).select("lang", "term", "source", share("n", "all", "v").alias("p"), "p0", share("n_lang", "all_lang", "v").alias("q")), "told", kept)

    typical = written(told.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value")), "typical")
    terms = highest(typical, top, tie_rows).withColumn("part", F.lit("term"))

    one = written(_one_sided(told, groups), "one")
    both = written(_two_sided(told), "both", told)
    # The result itself has a row for every pair of sources of a language.
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.select("lang", "source", "v", "p0").join(other, "lang").where(F.col("source") != F.col("item"))
    pairs = pairs.join(one, ["lang", "source", "q0"], "left")
    pairs = pairs.join(one.select("lang", F.col("source").alias("item"), F.col("q0").alias("p0"), F.col("one").alias("two")), ["lang", "item", "p0"], "left")
    pairs = pairs.withColumns({"low": F.least("source", "item"), "high": F.greatest("source", "item")}).join(both, ["lang", "low", "high"], "left")
    value = F.coalesce(F.col("v") * apart(F.col("p0"), F.col("q0")), F.lit(0)) + F.coalesce("one", F.lit(0)) + F.coalesce("two", F.lit(0)) + F.coalesce("both", F.lit(0))
    pairs = pairs.select("lang", "source", "item", value.alias("value"), F.lit("pair").alias("part"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


AUDIT_SQL = r"""
with docs as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), tokens as (
  select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), counts as (
  select lang, source, term, count(*) as n, count(distinct id) as docs from tokens group by all
), kept as (
  select lang, term, sum(n)::hugeint as n_lang from counts group by all having sum(docs) >= 10
), langs as (
  select lang, count(*)::hugeint as v, sum(n_lang)::hugeint as all_lang from kept group by lang
), held as (
  select c.lang, c.source, c.term, c.n::hugeint as n from counts c join kept k using (lang, term)
), sources as (
  select distinct lang, source from docs
), groups as (
  select s.lang, s.source, coalesce(sum(h.n), 0)::hugeint as total from sources s left join held h using (lang, source) group by all
), shares as (
  select g.lang, g.source, k.term, coalesce(h.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(h.n, 0) + 2)) // (g.total + 2 * l.v) as p,
    1 + (1000000000::hugeint * (k.n_lang + 2)) // (l.all_lang + 2 * l.v) as q
  from groups g join kept k using (lang) join langs l using (lang) left join held h on h.lang = g.lang and h.source = g.source and h.term = k.term
), sums as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value
  from sources a join sources b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
), terms as (
  select lang, source, term as item, ((p - q) * (p - q)) // (p + q) as value from shares where n > 0 and p > q
), ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select * from (select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) as rank from terms) where rank <= 10
)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked
"""
