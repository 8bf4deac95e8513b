"""Quality rules with host verdicts (operator 4).

Every text gets integer statistics in one vectorised pass inside Arrow batches. A host's failures of each of the
`RULES` are aggregated, its rates are shrunk by a beta prior for each rule, fitted to all hosts by moments, and a host
of which some rate is surely too high rejects all its documents. A document of another host goes only if it fails the
base rules itself.

Nulls and empty texts have no words and fail the base rules. A null host is a host of its own. Repeated
rows count each time and each come back. Ties don't arise: nothing is ranked. A task holds a text whole, with
about 10 bytes of memory for each byte of the longest and 60 for each of its words and lines. `accepted` returns extra columns, whatever their names;
`judge` ignores them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.stage import few_rows, written
from tessella.llm.textblock import SPACE, Block, blocks, counts_by_text, mix, spans_hash, window_hash

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Failures that count against a host, by columns or arrays of statistics: the base rules, more than one symbol for ten words,
#: more than 30 % of the lines with a word repeated, and words of under 2 or over 20 characters on average.
RULES = {
    "base_failed": lambda s: (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"]),
    "many_symbols": lambda s: 10 * s["n_symbols"] > s["n_words"],
    "many_dup_lines": lambda s: 10 * s["n_dup_lines"] > 3 * s["n_lines"],
    "odd_words": lambda s: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 20 * s["n_words"]),
}

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[place] > 1


def _later_equal(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands earlier."""
    flags = np.ones(len(keys), bool)
    flags[np.unique(keys, return_index=True)[1]] = False
    return flags


def block_stats(block: Block) -> dict[str, np.ndarray]:
    """The statistics of every text of a block."""
    data, offsets = block.data, block.offsets
    n = len(block)
    starts, ends, bounds = block.words()
    word_of = np.repeat(np.arange(n), np.diff(bounds))

    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(7))
    covered = np.zeros(len(starts), bool)
    windows = window_hash(spans_hash(data, starts, ends), 3)
    inside = word_of[: len(windows)] == word_of[2:] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    hit = at[_repeated(windows[at] ^ salt[word_of[at]])]
    for k in range(3):
        covered[hit + k] = True

    newline = np.flatnonzero(data == 0x0A)
    cuts = np.concatenate([offsets[:-1], newline + 1])
    stops = np.concatenate([newline, offsets[1:]])
    cuts.sort()
    stops.sort()
    dark = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=dark[1:])
    full = dark[stops] > dark[cuts]
    cuts, stops = cuts[full], stops[full]
    line_of = np.searchsorted(offsets, cuts, "right") - 1
    again = _later_equal(spans_hash(data, cuts, stops) ^ salt[line_of])

    return {
        "n_words": np.diff(bounds),
        "word_chars": counts_by_text(~SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": counts_by_text(_IS_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_of[again], minlength=n).astype(np.int64),
        "n_repeat_words": counts_by_text(covered, bounds),
        "n_lines": np.bincount(line_of, minlength=n).astype(np.int64),
    }


def text_stats(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """The key columns and the statistics of each row's whole text."""
    kept = df.select(*keys, F.col(text).cast("string").alias("_text"))
    fields = [f for f in kept.schema.fields if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + "".join(f", {s} long" for s in STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            found: dict[str, list[np.ndarray]] = {s: [] for s in STATS}
            for block in blocks(batch.column(at)):
                for name, values in block_stats(block).items():
                    found[name].append(values)
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            columns += [pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in found.values()]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), *STATS])

    return kept.mapInArrow(run, schema)


def host_verdicts(failures: DataFrame, host: str, failed: list[str], max_rate: float = 0.5, z: float = 1.645) -> DataFrame:
    """One row per host: rows, failures of any rule, prior, shrunk rate and its lower bound, and `host_bad`.

    The prior is a beta distribution whose mean and spread are those of all hosts' rates (method of
    moments, each host weighed by its rows); a host is bad if the lower bound of its posterior rate
    exceeds `max_rate` for some rule.
    """
    per_host = failures.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f).cast("long")).alias(f"bad_{f}") for f in failed))
    overall = per_host.agg(
        F.sum("n").alias("all_n"),
        F.sum(F.col("n") * F.col("n")).alias("all_nn"),
        F.count(F.lit(1)).alias("hosts"),
        *(F.sum(f"bad_{f}").alias(f"all_{f}") for f in failed),
        *(F.sum((F.col(f"bad_{f}") * F.col(f"bad_{f}")).cast("double") / F.col("n")).alias(f"sq_{f}") for f in failed),
    )
    # `overall` is a single row, whatever the input.
    both = per_host.crossJoin(F.broadcast(overall))
    bad = F.lit(False)
    for f in failed:
        mean = F.col(f"all_{f}") / F.col("all_n")
        between = (F.col(f"sq_{f}") - F.col(f"all_{f}") * mean) / F.col("all_n")
        spread = mean * (1 - mean)
        within = spread * F.col("hosts") / F.col("all_n")
        variance = F.greatest(between - within, spread * F.lit(1e-6))
        strength = F.when(spread > 0, F.least(F.greatest(spread / variance - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1.0))
        a = F.col(f"bad_{f}") + strength * mean
        m = F.col("n") + strength
        rate = a / m
        bound = rate - z * F.sqrt(rate * (1 - rate) / (m + 1))
        both = both.withColumns({f"rate_{f}": rate, f"low_{f}": bound})
        bad = bad | (F.col(f"low_{f}") > max_rate)
    return both.withColumn("host_bad", bad).drop("all_n", "all_nn", "hosts", *(f"all_{f}" for f in failed), *(f"sq_{f}" for f in failed))


def _failures() -> list[Column]:
    told = {name: F.col(name) for name in STATS}
    return [rule(told).alias(name) for name, rule in RULES.items()]


def accepted(docs: DataFrame, max_rate: float = 0.5, z: float = 1.645) -> DataFrame:
    """The input's rows that `judge` keeps, with the input's columns; texts are not shuffled."""
    few_rows(docs.sparkSession)
    stats = text_stats(docs.select(F.col("source").alias("_host"), F.col("text").alias("_told")), "_told", "_host")
    hosts = written(host_verdicts(stats.select("_host", *_failures()), "_host", list(RULES), max_rate, z).where("host_bad").select("host"), "hosts")
    # One struct carries the row, so that no name of a column meets those used here.
    own = docs.select(F.col("source").alias("_host"), F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("_row"))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).field(place)
            good = [np.zeros(0, bool)]
            for block in blocks(text if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else text.cast(pa.string())):
                good.append(~RULES["base_failed"](block_stats(block)))
            yield batch.filter(pa.array(np.concatenate(good)))

    rows = own.mapInArrow(run, own.schema)
    return rows.join(hosts, F.col("_host").eqNullSafe(F.col("host")), "left_anti").select(*(F.col("_row").getField(name).alias(name) for name in docs.columns))


def judge(docs: DataFrame, max_rate: float = 0.5, z: float = 1.645) -> DataFrame:
    """doc_id, the statistics, the failures of each rule, the host's verdict and kept, one row per input row."""
    stats = text_stats(docs, "text", "doc_id", "source")
    stats = written(stats.select("*", *_failures()), "quality")
    hosts = host_verdicts(stats, "source", list(RULES), max_rate, z).select("host", "host_bad")
    joined = stats.join(hosts, stats["source"].eqNullSafe(hosts["host"]), "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("host_bad"), F.lit(False))
    return joined.select("doc_id", *STATS, *RULES, F.col("source").alias("host"), F.coalesce(F.col("host_bad"), F.lit(False)).alias("host_bad"), kept.alias("kept"))


JUDGE_SQL = r"""
with words as (
  select rowid_, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from (
    select row_number() over () as rowid_, doc_id, source, coalesce(text, '') as text from documents)
), grams as (
  select rowid_, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as g
  from (select rowid_, w, unnest(range(1, len(w) - 1)) as i from words)
), repeated as (
  select rowid_, i from (select rowid_, i, count(*) over (partition by rowid_, g) as c from grams) where c > 1
), covered as (
  select rowid_, count(distinct i + k) as n from repeated, (select unnest([0, 1, 2]) as k) group by rowid_
), lines as (
  select rowid_, l, count(*) as c from (select rowid_, unnest(string_split(text, chr(10))) as l from words)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by rowid_, l
), dups as (
  select rowid_, sum(c - 1)::bigint as n, sum(c)::bigint as n_lines from lines group by rowid_
), stats as (
  select a.rowid_, doc_id, source, len(w)::bigint as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(d.n, 0)::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(d.n_lines, 0)::bigint as n_lines
  from words a left join dups d using (rowid_) left join covered c using (rowid_)
), base as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, 10 * n_symbols > n_words as many_symbols,
    10 * n_dup_lines > 3 * n_lines as many_dup_lines, word_chars < 2 * n_words or word_chars > 20 * n_words as odd_words
  from stats
), failures as (
  select source as host, unnest(['base_failed', 'many_symbols', 'many_dup_lines', 'odd_words']) as rule,
    unnest([base_failed, many_symbols, many_dup_lines, odd_words]) as failed from base
), per_host as (
  select rule, host, count(*)::double as n, sum(failed::int)::double as bad from failures group by rule, host
), overall as (
  select rule, sum(n) as all_n, sum(bad) as all_bad, sum(bad * bad / n) as sq, count(*)::double as hosts from per_host group by rule
), prior as (
  select *, mu * (1 - mu) as spread, greatest((sq - all_bad * mu) / all_n - mu * (1 - mu) * hosts / all_n, mu * (1 - mu) * 1e-6) as variance
  from (select *, all_bad / all_n as mu from overall)
), strength as (
  select rule, mu, case when spread > 0 then least(greatest(spread / variance - 1, 1.0), 1e6) else 1.0 end as m from prior
), rates as (
  select host, (bad + m * mu) / (n + m) as rate, n + m as weight from per_host join strength using (rule)
), verdicts as (
  select host, bool_or(rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) > 0.5) as host_bad from rates group by host
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, many_symbols, many_dup_lines, odd_words,
  host, host_bad, not base_failed and not host_bad as kept
from base join verdicts on source is not distinct from host
"""
