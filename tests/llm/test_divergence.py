import random
import re
from collections import Counter, defaultdict

import pytest

from tessella.llm import divergence
from tests.llm.conftest import lowered

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    """The contract, group by group over all kept terms."""
    docs = [(lang or "", source or "", TERM.findall(lowered(text))) for _, text, lang, source in rows]
    df, counts, out = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = sorted({s for x, s in counts if x == lang}, key=str.encode)
        of = {s: Counter({t: counts[lang, s][t] for t in kept}) for s in sources}
        whole = sum(of.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(sum(f(p(of[s], t), p(of[o], t)) for t in kept), o) for o in sources if o != s]
            terms = [(f(p(of[s], t), p(whole, t)), t) for t in kept if of[s][t] > 0 and p(of[s], t) > p(whole, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])}
    return out


def drawn(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "été", "日本", "a", "b", "zz", "Ünder", *(f"w{c}" for c in "abcdefgh"), *(f"tie{c}{d}" for c in "abcd" for d in "éxyz")]
    made = []
    for k in range(n):
        source = rng.choice(["s0", "s0", "s1", "s2", None, "é"])
        own = vocabulary if source != "s1" else vocabulary[::2]
        made.append((k, rng.choice([None, "", "12 34"]) if rng.random() < 0.05 else " 1-".join(rng.choices(own, k=rng.randint(1, 30))), rng.choice(["en", "de", None]), source))
    return [*made, (n, "!!", "en", "empty"), (n + 1, None, "xx", "alone"), (n + 2, "x", "xx", "other"), made[3], made[3]]


def told(df):
    return {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize(("seed", "tie_rows"), [(1, 1000), (2, 1)])
def test_audit_equals_brute_force(docs_of, seed, tie_rows):
    rows = drawn(seed)
    assert told(divergence.audit(docs_of(rows, extra=True), least=6, top=5, tie_rows=tie_rows)) == brute(rows, 6, 5)


def test_blocks_of_terms_sum_to_the_same(docs_of, monkeypatch):
    rows = drawn(3, 60)
    monkeypatch.setattr(divergence, "TERM_ROWS", 10)
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 64)
    monkeypatch.setattr(divergence, "FLUSH_ROWS", 20)
    assert told(divergence.audit(docs_of(rows), least=3)) == brute(rows, 3, 10)


def test_no_documents_and_long_terms(docs_of):
    assert divergence.audit(docs_of([])).collect() == []
    long = "x" * 300_000
    rows = [(k, f"{long}{k % 2} y", "en", f"s{k % 3}") for k in range(30)]
    assert told(divergence.audit(docs_of(rows))) == brute(rows, 10, 10)


@pytest.mark.parametrize("tie_rows", [1, 3, 100])
def test_highest_tells_many_ties_apart_by_bytes(spark, tie_rows):
    rng = random.Random(tie_rows)
    rows = [("en", f"s{g}", item, value) for g in range(3) for item, value in {"".join(rng.choices("aéz日", k=rng.randint(1, 6))): rng.choice([0, 7, 7, 7, 2**30 - 1]) for _ in range(40 * g + 3)}.items()]
    got = {tuple(r) for r in divergence.highest(spark.createDataFrame(rows, "lang string, source string, item string, value long"), 10, tie_rows).collect()}
    want = set()
    for s in ("s0", "s1", "s2"):
        own = sorted(((-v, i.encode(), i) for _, g, i, v in rows if g == s))[:10]
        want |= {("en", s, i, -v, k + 1) for k, (v, _, i) in enumerate(own)}
    assert got == want
