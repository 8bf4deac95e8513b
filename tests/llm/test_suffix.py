import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import suffix
from tessella.llm.textblock import blocks
from tests.llm.conftest import sha

LENGTH, GRAM = 40, 10


def brute(texts, length):
    seen = Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


def corpus(seed, alphabet="abcdefgh é"):
    rng = random.Random(seed)
    base = "".join(rng.choice(alphabet) for _ in range(400))
    out = []
    for _ in range(14):
        at = rng.randint(0, 300)
        part = list(base[at : at + rng.randint(1, 250)])
        if rng.random() < 0.5:
            part[rng.randrange(len(part))] = rng.choice(alphabet)
        out.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) + "".join(part))
    return [*out, None, "", out[0], out[0], base * 2]


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array_is_sorted(seed):
    rng = random.Random(seed)
    symbols = np.array([rng.choice([1, 2, 3] if seed % 2 else [1]) for _ in range(rng.randint(1, 300))], np.uint16)
    order = suffix.suffix_array(symbols, 10**6)
    raw = symbols.astype(np.uint8).tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


@pytest.mark.parametrize("seed", range(20))
def test_equal_windows_meet_in_one_group(seed):
    texts = [t or "" for t in corpus(seed, "ab" if seed % 3 == 0 else "abcdefgh é")]
    seen, groups = Counter(), {}
    for block in blocks(pa.array(texts), 300):
        for h, _, t, a, n in zip(*(x.tolist() for x in suffix.pieces_of(block, LENGTH, GRAM)), strict=True):
            data = texts[block.first + t].encode()
            for i in range(a, a + n):
                seen[block.first + t, i] += 1
                groups.setdefault(data[i : i + LENGTH], set()).add(h)
    assert set(seen.values()) <= {1}
    assert len(seen) == sum(max(0, len(t.encode()) - LENGTH + 1) for t in texts)
    assert all(len(g) == 1 for g in groups.values())


@pytest.mark.parametrize(("alphabet", "limit"), [("abcdefgh é", 4096), ("abcdefgh é", 1), ("ab", 4096)])
def test_digest_equals_brute_force(docs_of, alphabet, limit):
    texts = corpus(3, alphabet)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.digest(docs_of(list(enumerate(texts)), extra=True), LENGTH, gram=GRAM, group_limit=limit).collect()}
    assert got == dict(enumerate(brute(texts, LENGTH)))


def test_null_ids_repeated_rows_and_empty(docs_of):
    text = "".join(chr(97 + (k * 7) % 26) for k in range(26)) * 3
    rows = [(None, text), (5, text), (5, text), (7, "short"), (7, None)]
    got = sorted(tuple(r)[1:3] for r in suffix.digest(docs_of(rows), LENGTH, gram=GRAM).collect())
    assert got == [(0, 0), (5, 0), (len(text), len(text)), (len(text), len(text)), (len(text), len(text))]
    assert suffix.digest(docs_of([])).collect() == []


def test_cut_keeps_columns_and_rest(docs_of):
    common = "the quick brown fox jumps over the lazy dog again and again"
    docs = docs_of([(1, "one-" + common + "-end"), (2, "two+" + common + "+fin"), (3, None)], extra=True)
    got = suffix.cut(docs, LENGTH, gram=GRAM)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "one--end", 2: "two++fin", 3: None}
    rest = [x for x in docs.columns if x != "text"]
    assert sorted(map(tuple, got.select(rest).collect())) == sorted(map(tuple, docs.select(rest).collect()))


@pytest.mark.parametrize("seed", range(10))
def test_windows_left_out_by_hash_don_t_repeat(seed):
    rng = random.Random(seed)
    texts = [t for t in corpus(seed, "ab" if seed % 2 else "abcdefgh") if t and len(t) >= LENGTH]
    pieces = [t.encode() for t in rng.sample(texts, min(len(texts), 8))]
    counts = np.array([rng.randint(1, len(p) - LENGTH + 1) for p in pieces])
    expected = suffix.repeated_starts(pieces, counts, LENGTH)
    assert suffix.repeated_windows(pieces, counts, LENGTH).tolist() == expected.tolist()


def test_long_texts_in_parts_have_the_same_windows():
    rng = random.Random(3)
    text = "".join(rng.choice("abc") for _ in range(1000))
    found = set()
    for block, skipped in suffix._parts(blocks(pa.array([text])), LENGTH, 130):
        for _, _, t, a, n in zip(*(x.tolist() for x in suffix.pieces_of(block, LENGTH, GRAM)), strict=True):
            assert t == 0
            found |= {(skipped + a + i) for i in range(n)}
    assert found == set(range(1000 - LENGTH + 1))


def test_slices_hold_all_rows():
    from tessella.llm.textblock import slices

    texts = ["abc", None, "", "x" * 50, "de", "fghij"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["k", "t"])
    for limit in (1, 4, 10, 1000):
        parts = list(slices(batch, 1, limit))
        assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert list(slices(batch.slice(0, 0), 1, 4)) == []


@pytest.mark.parametrize("limit", [1, 7, 40, 1000])
def test_hashes_of_spans_do_not_depend_on_segments(limit):
    from tessella.llm.textblock import Block, spans_hash

    data = np.frombuffer(("word " * 5 + "x" * 90 + " end of it").encode(), np.uint8)
    starts, ends, _ = Block(0, data, np.array([0, len(data)])).words()
    got = spans_hash(data, starts, ends, limit).tolist()
    assert got == spans_hash(data, starts, ends).tolist()
    assert len(set(got[:5])) == 1 and len(set(got)) == 5


@pytest.mark.parametrize("power", [9, 11, 14])
def test_spans_of_a_regular_pattern_and_its_mirror_differ(power):
    from tessella.llm.textblock import spans_hash

    pattern = np.bitwise_count(np.arange(1 << power)) % 2
    data = np.concatenate([pattern, 1 - pattern]).astype(np.uint8) + 97
    half = 1 << power
    assert len(set(spans_hash(data, np.array([0, half]), np.array([half, 2 * half])).tolist())) == 2
