import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import phrases
from tests.llm.conftest import lowered


def brute(rows, max_words, least, first):
    """The contract by counting all phrases of all pieces."""
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f[lang].update(tuple(w[i : i + m]) for m in range(1, max_words + 1) for i in range(len(w) - m + 1))
    out = set()
    for lang, counts in f.items():
        often = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in often.items():
            score, k = min((1000 * a * total[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            inside = any(len(x) > len(g) and b >= a and any(x[i : i + len(g)] == g for i in range(len(x) - len(g) + 1)) for x, b in often.items())
            if not inside:
                found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        found.sort()
        out |= {(lang, r + 1, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(found[:first])}
    return out


def drawn(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["of", "the", "The", "été", "日本", "a", "b\x01", "x-y", "\xa0z", "end"]
    joints = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ;"]
    made = []
    for k in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice(joints) for _ in range(rng.randint(0, 25)))
        made.append((k, rng.choice([None, "", "of the end of the a"]) if rng.random() < 0.2 else text, rng.choice(["en", "en", "de", None, "und"])))
    return [*made, made[3], made[3], (n, "rare words " * 3, "xx"), (n + 1, "ha " * 400, "en")]


def told(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


@pytest.mark.parametrize(("seed", "codes", "flush", "first"), [(1, 0xFFFF, 1 << 20, 2000), (2, 4, 50, 2000), (3, 0, 1, 5)])
def test_collocations_equal_brute_force(docs_of, monkeypatch, seed, codes, flush, first):
    monkeypatch.setattr(phrases, "FLUSH", flush)
    rows = drawn(seed)
    monkeypatch.setattr(phrases, "CODES", codes)  # so few words have short codes
    assert told(phrases.collocations(docs_of(rows, extra=True), least=4, first=first)) == brute(rows, 5, 4, first)


def test_words_that_share_a_key_are_keyed_anew(docs_of, monkeypatch):
    rows, seeds = drawn(5, 60), []
    counts = phrases.word_counts
    monkeypatch.setattr(phrases, "word_counts", lambda own, least, keying: seeds.append(keying.seed) or counts(own, least, keying))
    assert told(phrases.collocations(docs_of(rows), 3, 3, keying=phrases.Keying(bits=3))) == brute(rows, 3, 3, 2000)
    assert seeds == [0, 1]


def test_no_documents_and_one_long_piece(docs_of):
    assert phrases.collocations(docs_of([])).collect() == []
    rows = [(1, "one two three " * 60_000, "en"), (2, "z" * 1_000_000 + " one two", "en")]
    assert told(phrases.collocations(docs_of(rows))) == brute(rows, 5, 100, 2000)


@pytest.mark.parametrize("known", [0, 3, 40])
def test_suffixes_come_back_from_their_bytes(known):
    rng = np.random.default_rng(known)
    keys = rng.integers(1, 2**63, 40).astype(np.uint64)
    rows = keys[rng.integers(0, 40, (200, 5))]
    rows[np.arange(5)[None, :] >= rng.integers(1, 6, 200)[:, None]] = 0
    codes = np.sort(keys[:known])
    data, offsets = phrases.encoded(rows, codes)
    assert (phrases.decoded(data, offsets, codes, 5) == rows).all()
    if known == 40:
        assert len(data) == 2 * (rows != 0).sum()


def test_equal_hashes_of_rows_are_seen():
    rows = np.array([[1, 2, 0], [1, 2, 0], [3, 0, 0]], np.uint64)
    found, count = phrases._summed(rows)
    assert sorted(zip(found.tolist(), count.tolist(), strict=True)) == [([1, 2, 0], 2), ([3, 0, 0], 1)]


def test_sieves_let_all_often_keys_pass_and_few_others(spark):
    from tessella.llm import sieve

    rng = np.random.default_rng(3)
    often, rare = rng.integers(1, 2**63, 300).astype(np.uint64), rng.integers(1, 2**63, 5000).astype(np.uint64)
    parts = np.array_split(rng.permutation(np.concatenate([np.repeat(often, 12), rare])), 7)
    rows = [b for part in parts for batch in sieve.slotted(iter([part])) for b in batch.to_pylist()]
    bits = sieve.slot_sieve(spark.createDataFrame(rows, "part int, low binary, high binary, counts binary"), 12).value
    assert sieve.passes(bits, often).all() and sieve.passes(bits, rare).sum() < 5
    counts = [r for part in parts for batch in sieve.counted(iter([np.unique(part, return_counts=True)])) for r in batch.to_pylist()]
    kept = sieve.often(spark.createDataFrame(counts, "k long, c long"), 12)
    assert {np.uint64(r["k"] % 2**64) for r in kept.collect()} == set(often)
    bits = sieve.sieve(kept).value
    assert sieve.passes(bits, often).all() and not sieve.passes(bits, rare).any()
