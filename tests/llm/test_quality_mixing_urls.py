import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing, quality, urls
from tests.llm.conftest import words


def stats(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(lines)


TEXTS = ["a b c a b c", "é# line\nother\né# line\n \n \n", None, "", "x " * 60, " ".join(f"w{k}" for k in range(60)), "\t\v one\x1fword\n\n", "a|b <c> a|b <c> a|b"]


def test_statistics_equal_brute_force(docs_of):
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality.judge(docs_of(list(enumerate(TEXTS)), extra=True)).collect()}
    assert got == {k: stats(t) for k, t in enumerate(TEXTS)}


def test_host_verdict_rejects_all_of_a_bad_host_only(docs_of):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(k, good, "en", "good") for k in range(40)] + [(100 + k, "bad", "en", "bad") for k in range(80)] + [(300, good, "en", "bad"), (301, good, "en", None)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs_of(rows)).collect()}
    assert all(got[k] for k in range(40)) and not got[300] and got[301]
    docs = docs_of(rows, extra=True)
    assert sorted(map(str, quality.accepted(docs).collect())) == sorted(map(str, docs.where(F.col("doc_id").isin([k for k, v in got.items() if v])).collect()))


WORDS60 = [f"word{k}" for k in range(60)]
BAD_TEXTS = {
    "many_symbols": " ".join(WORDS60) + " #" * 8,
    "many_dup_lines": "\n".join([*WORDS60, "one more line", *["one more line"] * 40]),
    "odd_words": " ".join(f"averyveryverylongword{k}" for k in range(60)),
    "base_failed": "few words",
}


@pytest.mark.parametrize("rule", BAD_TEXTS)
def test_each_rule_rejects_a_bad_host_and_no_other(docs_of, rule):
    fine = " ".join(WORDS60)
    hosts = {"bad": [BAD_TEXTS[rule]] * 60 + [fine] * 2, "mixed": [BAD_TEXTS[rule]] * 10 + [fine] * 50, "clean": [fine] * 60}
    rows = [(1000 * h + k, text, "en", host) for h, (host, texts) in enumerate(hosts.items()) for k, text in enumerate(texts)]
    got = quality.judge(docs_of(rows)).collect()
    assert {r["host"] for r in got if r["host_bad"]} == {"bad"}
    assert {r["doc_id"] for r in got if r[rule]} == {d for d, text, _, _ in rows if text == BAD_TEXTS[rule]}
    assert all(r["kept"] == (r["host"] != "bad" and not r["base_failed"]) for r in got)


def test_empty_tables(docs_of, spark):
    assert quality.judge(docs_of([])).collect() == []
    assert mixing.mix(docs_of([])).collect() == []
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_targets_fill_water(docs_of, spark):
    sizes = [("a", 100), ("b", 1000), ("c", 10), (None, 500)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    weight, cap = {"a": 1, "b": 2, "c": 3, None: 1}, {s: 3 * n for s, n in sizes}
    target, left, open_ = {}, 1610.0, set(weight)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
        open_ -= over
    assert got == pytest.approx(target)


def test_mix_comes_near_targets_and_repeats(docs_of):
    rows = [(k, "w " * (1 + k % 7), "en", f"s{k % 3}") for k in range(600)] + [(1000, None, "en", "s0"), (None, "w", "en", None)]
    first, again = (sorted(map(tuple, mixing.mix(docs_of(rows, extra=True)).collect()), key=str) for _ in range(2))
    assert first == again
    by = {}
    for _, source, size, _, target, copies, taken in first:
        assert taken == copies * size <= 3 * size
        t = by.setdefault(source, [target, 0])
        t[1] += taken
    assert all(abs(t - got) <= 7 for t, got in by.values())
    assert mixing.mixture(docs_of(rows)).count() == sum(r[5] for r in first)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://A.Example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7"),
        ("https://other.com/en/7", "other.com", "/en/7", "com/en/"),
        ("x://example.net/de/81", "example.net", "/de/81", "example.net/de/8"),
        ("x://notcom/en/", "notcom", "/en/", None),
        ("http://com/en/", "com", "/en/", "com/en/"),
        ("no scheme", "", "", None),
        (None, "", "", None),
        ("http://h?x=://", "h", "", None),
        ("http://org/ES/", "org", "/ES/", None),
    ],
)
def test_url_parts_and_rules(spark, url, host, path, rule):
    r = urls.judge_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).collect()[0]
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule)


def test_reputation_blocks_hosts_like_their_labelled_pages(spark):
    rows = [(k, f"http://bad.x.org/es/{k}") for k in range(50)] + [(100 + k, f"http://good.y.net/de/{k}") for k in range(50)] + [(200, "http://bad.x.org/other"), (201, "http://good.y.net/other")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200] == "block" and got[201] == "allow"
