import random
from collections import Counter, defaultdict

import pytest

from tessella.llm import jaccard
from tests.llm.conftest import lowered, words


def brute(rows, width=5, percent=75):
    sets = []
    for _, t in rows:
        w = words(lowered(t))
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for e in s:
            where[e].append(i)
    common = Counter((a, b) for m in where.values() for k, a in enumerate(m) for b in m[k + 1 :])
    for (a, b), o in common.items():
        if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
            parent[root(b)] = root(a)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 120))] for _ in range(4)]
    rows = []
    for k in range(70):
        text = list(rng.choice(base)) if rng.random() < 0.8 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((k, " ".join(text)))
    return [*rows, (100, None), (101, ""), (102, " \n\t"), (103, "one two"), (104, "One TWO"), (105, "one two three"), (0, rows[0][1])]


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(docs_of, seed):
    rows = corpus(seed)
    assert Counter(tuple(r) for r in jaccard.join(docs_of(rows, extra=True)).collect()) == brute(rows)


def test_without_pivots(docs_of, monkeypatch):
    rows = corpus(9)
    told = jaccard.components(docs_of(rows), rounds=0)
    assert Counter((r["_d"], r["n"], r["component_id"]) for r in told.collect()) == brute(rows)


def test_empty_and_null_id(docs_of):
    assert jaccard.join(docs_of([])).collect() == []
    text = " ".join(f"a{k}" for k in range(30))
    assert {tuple(r) for r in jaccard.join(docs_of([(None, text), (4, text)])).collect()} == {(None, 26, 4), (4, 26, 4)}


def test_deduplicate_keeps_one_of_each(docs_of):
    rows = corpus(1)
    expected = {c for _, n, c in brute(rows) if n} | {100, 101, 102}
    kept = [r["doc_id"] for r in jaccard.deduplicate(docs_of(rows)).collect()]
    assert sorted(kept) == sorted(expected)


def test_deduplicate_tells_components_apart_without_ids(docs_of):
    rng = random.Random(4)
    fresh = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    a, b, c, d, e, f = (fresh() for _ in range(6))
    # Two components of null ids only, two lone texts with null ids, and two lone texts that share an id.
    rows = [(None, a), (None, a + " x"), (None, b), (None, b + " y"), (None, c), (None, d), (7, e), (7, f)]
    kept = Counter(r["text"] for r in jaccard.deduplicate(docs_of(rows)).collect())
    assert sum(kept[x] for x in (a, a + " x")) == sum(kept[x] for x in (b, b + " y")) == 1
    assert [kept[x] for x in (c, d, e, f)] == [1] * 4 and sum(kept.values()) == 6
    assert {r["component_id"] for r in jaccard.join(docs_of(rows)).collect()} == {None, 7}


def test_gathered_batches_hold_all_rows_in_order_within_the_limit():
    import pyarrow as pa

    from tessella.llm.textblock import gathered

    texts = ["x" * (k % 40) if k % 9 else None for k in range(500)] + ["y" * 300]
    parts = pa.Table.from_pydict({"n": list(range(501)), "t": texts}).to_batches(max_chunksize=7)
    got = list(gathered(iter(parts), 1, 200))
    assert [n for b in got for n in b["n"].to_pylist()] == list(range(501)) and [t for b in got for t in b["t"].to_pylist()] == texts
    assert len(got) < len(parts) and all(sum(len(t or "") for t in b["t"].to_pylist()) <= 240 for b in got[:-1])
    assert list(gathered(iter([]), 1, 200)) == []
