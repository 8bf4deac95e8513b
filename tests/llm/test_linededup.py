import random
from collections import defaultdict

import numpy as np
import pytest

from tessella.llm import linededup
from tests.llm.conftest import CLASHING, counted, lowered, sha

BLANK = " \t\n\v\f\r"


def brute(rows, least_chars, least_docs):
    """Kept text, lines and dropped lines of each row."""
    rank = lambda d: (d is not None, d or 0)
    holds = defaultdict(list)
    for k, (doc, text, *_) in enumerate(rows):
        for key in {lowered(line).strip(BLANK) for line in (text or "").split("\n")}:
            if len(key) >= least_chars:
                holds[key].append((rank(doc), k))
    keeper = {key: max(held)[0] for key, held in holds.items() if len(held) >= least_docs}
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(lowered(x).strip(BLANK), rank(doc)) == rank(doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def drawn(seed):
    rng = random.Random(seed)
    common = ["a common line", "A Common LINE\t", " éééé ", "日本語日本", "abc", "ab", "", "  \r", "often " * 3, "x\x1fy z"]
    rows = []
    for k in range(150):
        lines = [rng.choice(common) if rng.random() < 0.6 else f"line {rng.randint(0, 60)}" for _ in range(rng.randint(0, 9))]
        rows.append((rng.choice([None, k, k, k]), None if rng.random() < 0.03 else "\n".join(lines)))
    return [*rows, rows[5], rows[5], (7, "often often often \nabc"), (1 << 40, "\n\n"), (-5, "")]


@pytest.mark.parametrize(("seed", "flush", "shard", "least"), [(1, 1 << 19, 1 << 17, (3, 5)), (2, 20, 7, (3, 3)), (3, 60, 1, (5, 2))])
def test_digest_equals_brute_force(docs_of, monkeypatch, seed, flush, shard, least):
    monkeypatch.setattr(linededup, "FLUSH", flush)
    monkeypatch.setattr(linededup, "SHARD_KEYS", shard)
    rows = drawn(seed)
    want = counted((d, n, gone, sha(kept.encode())) for d, n, gone, kept in brute(rows, *least))
    assert counted(linededup.digest(docs_of(rows, extra=True), *least).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == want


def test_dedup_returns_all_columns_and_leaves_nulls(docs_of):
    rows = drawn(4)
    got = linededup.dedup(docs_of(rows, extra=True), 3, 4)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    assert counted((r["doc_id"], r["text"]) for r in got.collect()) == counted((d, None if row[1] is None else kept) for row, (d, _, _, kept) in zip(rows, brute(rows, 3, 4), strict=True))


def test_no_documents_long_texts_and_one_document(docs_of, monkeypatch):
    assert linededup.digest(docs_of([])).collect() == []
    with pytest.raises(ValueError, match="least_docs"):
        linededup.drops(docs_of([]), 40, 1)
    long = "\n".join(["y" * 2_000_000, *(f"line number {k} of a very long text" for k in range(50_000))])
    rows = [(k, long) for k in range(6)] + [(9, "y" * 2_000_000)]
    want = counted((d, n, gone, sha(kept.encode())) for d, n, gone, kept in brute(rows, 20, 5))
    assert counted(linededup.digest(docs_of(rows), 20).collect()) == want


@pytest.mark.parametrize("n", [0, 1, 63, 5000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 1 << 63, n).astype(np.uint64)
    a[: n // 2] = 17  # told apart by the second number alone
    made = linededup.PerfectHash.of(a, b)
    assert sorted(made.places(a, b).tolist()) == list(range(n))
    assert len(made.bits) <= 4 * n + 700
    strangers = made.places(b, a)
    assert ((strangers >= -1) & (strangers < max(n, 1))).all()
