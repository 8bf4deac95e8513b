import math
import random
import time
import zlib
from collections import Counter

import pytest

from tessella.llm import ann, html, langid, lm, packing
from tests.llm.conftest import lowered, words

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<!-- <p>hidden</p> --><article><h1>Head &amp; line</h1><p>One<br>two &#233; <b>bold</b>
 text</p><aside>side</aside><form><p>Sign up</p></form><p>Last.</p><section class="comments"><p>A reader says</p></section></article>
<div class="ad">Buy</div><footer>&copy; me</footer></body></html>"""


def test_article_without_its_surroundings():
    assert html.main_text(PAGE) == "Head & line\n\nOne two é bold text\n\nLast."


def test_page_without_article_keeps_the_dense_part():
    long = "Plain words that go on and on for quite a while, far past any menu entry, as articles do."
    page = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><div><p>{long}</p><p>Short.</p><p>{long}</p></div><div class='footer'>bye</div></body>"
    assert html.main_text(page) == f"{long}\n\nShort.\n\n{long}"


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p>open", "open"), ("a < b", "a < b"), ("<article><p>x<script>y", "x"), ("<p title='a>b'>c</p>", "c"), ("<article>" + "<div>" * 3000 + "deep", "deep")])
def test_odd_pages(page, text):
    assert html.main_text(page) == text


def kept_by_rule(lines, window, surge):
    """The documented rule, line by line."""
    out = [False] * len(lines)
    sums = {}
    for d in {x.doubts for x in lines}:
        own = [k for k, x in enumerate(lines) if x.doubts == d]
        for at in range(len(own) + window - 1):
            sums[d, at] = sum(lines[own[k]].length for k in range(at - window + 1, at + 1) if 0 <= k < len(own))
    peak = max(sums.values(), default=0)
    for d in {x.doubts for x in lines}:
        own = [k for k, x in enumerate(lines) if x.doubts == d]
        at = 0
        while at < len(own):
            stop = at
            while sums.get((d, stop), 0) > 0:
                stop += 1
            if stop > at and any(sums[d, k] >= min(surge, peak) for k in range(at, stop)):
                inside = [k for k in range(at, min(stop, len(own))) if lines[own[k]].length]
                for k in range(inside[0], inside[-1] + 1):
                    out[own[k]] = True
            at = max(stop, at + 1)
    return "\n\n".join(x.text for x, keep in zip(lines, out, strict=True) if keep and x.text)


@pytest.mark.parametrize("seed", range(40))
def test_kept_lines_follow_the_rule(seed):
    rng = random.Random(seed)
    tags = ["p", "div", "div class=ad", "div class='sidebar'", "section", "article", "nav", "footer", "li", "h2", "a href=x", "b"]

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            return "word " * rng.choice([0, 1, 3, 12, 40])
        tag = rng.choice(tags)
        return f"<{tag}>{''.join(part(depth - 1) for _ in range(rng.randint(0, 5)))}</{tag.split()[0]}>"

    page = "".join(part(4) for _ in range(12))
    window, surge = rng.choice([1, 2, 3, 5]), rng.choice([20, 80, 200])
    assert html.main_text(page, window, surge) == kept_by_rule(html.page_lines(page), window, surge)


def test_the_window_decides():
    long = "Plain words that go on and on for quite a while, far past any menu entry, as articles do. " * 10
    # A long text in a box with an odd name stays, a short one goes, and so does a short line far from the text.
    assert html.main_text(f"<div class='social'><p>{long}</p></div><div class=promo>Buy now</div>") == long.strip()
    assert html.main_text(f"<p>Lost</p><nav><p>a</p><p>b</p><p>c</p></nav><p>{long}</p><p>Near</p>") == long.strip() + "\n\nNear"
    # Links within the text stay, links around it go.
    menu = "<ul>" + "<li><a href=x>Go there</a></li>" * 5 + "</ul>"
    assert html.main_text(f"{menu}<p>{long}</p><p><a href=y>Source</a></p><p>{long}</p>{menu}") == f"{long.strip()}\n\nSource\n\n{long.strip()}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>Before it, long enough.</p><svg><p>After one, long enough, too.</p><p>And a third one.</p></article>", "Before it, long enough.\n\nAfter one, long enough, too.\n\nAnd a third one."),
        ("<article><p>Before it, long enough.</p><button><p>After one, long enough, too.</p></article>", "Before it, long enough.\n\nAfter one, long enough, too."),
        ("<article><p>x <math>a</math> z</p><p>He wrote <textarea>x</textarea>.</p><p>one<script>x</script> two</p></article>", "x z\n\nHe wrote .\n\none two"),
        ("<article><p data-x=it's>First paragraph stays.</p><p>It's the second.</p></article>", "First paragraph stays.\n\nIt's the second."),
        ("<article><p title='a > b' class = \"c > d\">Quotes hold a sign.</p></article>", "Quotes hold a sign."),
        ("<article><p>Before it.</p><style>p { <p>gone</p>", "Before it."),
    ],
)
def test_open_and_inline_elements_and_stray_quotes(page, text):
    assert html.main_text(page) == text


def test_stray_end_tags_take_constant_time():
    import time

    began = time.time()
    assert html.main_text("<div>" * 20000 + "text" + "</ul>" * 20000) == "text"
    assert time.time() - began < 5


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None)], "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["n_chars"], len(r["text"])) for r in html.extract(pages).collect()))
    assert got == [(1, 39, 39), (1, 39, 39), (2, 0, 0)]
    assert html.extract(pages.limit(0)).collect() == []


LANGS = {"aa": "the of and ing that with ness", "bb": "der die und ung nicht keit ist", "cc": "le la que ment une eau tion"}


def text_of(lang, rng, n=40):
    return " ".join(rng.choice(LANGS[lang].split()) + rng.choice(LANGS[lang].split()) for _ in range(n))


def test_language_accuracy_on_held_out_rows(docs_of):
    rng = random.Random(2)
    rows = [(k, text_of(lang, rng, rng.randint(3, 40)), lang) for k in range(240) for lang in [rng.choice(sorted(LANGS))]]
    rows += [(1000, None, None), (1001, "123 !?", "aa"), (1002, "", "bb"), (1003, text_of("aa", rng), None)]
    docs = docs_of(rows, extra=True)
    truth = {r[0]: r[2] for r in rows}
    got = langid.predict(docs, langid.fit(docs)).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1000, 1001, 1002}


def test_sample_is_bounded(docs_of):
    rows = [(None, f"the of number {k}", "aa") for k in range(200)] + [(7, "der die", "bb")] * 50 + [(k, "le la", f"l{k}") for k in range(100, 140)]
    found = langid.sample(docs_of(rows), 10, 4, 2, 5).collect()
    count = Counter(r["lang"] for r in found)
    assert count["aa"] == 10 and count["bb"] in (0, 10) and len(count) <= 5 and max(count.values()) == 10


def test_no_labels(docs_of, spark):
    docs = docs_of([(1, "hello")]).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))
    assert [r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()] == ["und"]
    empty = docs.limit(0)
    assert langid.predict(empty, langid.fit(empty)).collect() == []


def lm_rows():
    """Sentences of a small grammar: what follows a word depends on up to two words before it."""
    rng = random.Random(4)
    vocabulary = ["The", "of", "and", *(f"v{k}" for k in range(60))]

    def text():
        out = [rng.choice(vocabulary) for _ in range(2)]
        for _ in range(rng.randint(0, 80)):
            at = vocabulary.index(out[-1]) * 7 + (vocabulary.index(out[-2]) % 3 if out[-1] in vocabulary[:20] else 0) * 11
            out.append(vocabulary[(at + rng.choice([0, 0, 0, 1, 2])) % 63] if rng.random() < 0.9 else rng.choice(vocabulary))
        return " ".join(out)

    return [(k, text()) for k in range(400)] + [(900, None), (901, "unseen words only"), (902, "")]


def brute_scores(rows, depth=lm.DEPTH):
    """Scores by the documented rule, from dictionaries of tuples; for texts of which every word is a symbol or is seen too rarely to be one."""
    token = [(zlib.crc32(str("" if d is None else d).encode()) % 5 == 1, [*words(lowered(t)), None]) for d, t in rows]
    train = [w for held, w in token if not held]
    count = Counter(x for w in train for x in w)
    n, v = sum(count.values()), len(count)
    symbols = {w for w, c in count.items() if c >= max(n * lm.SYMBOL_SHARE, lm.LEAST_COUNT)}
    base = lambda w: (count[w] + 0.5) / (n + 0.5 * (v + 1))
    top = {w: base(w) for w in symbols}
    rest_of = 1 - sum(top.values())
    other = object()
    as_symbols = lambda w: [x if x in symbols else other for x in w]
    states = {(): None}

    def p(context, s):
        if not context:
            return top.get(s, rest_of)
        total, entries = states[context]
        rest = total - sum(entries.values()) + lm.STRENGTH
        return (entries.get(s, 0) + rest * p(context[1:], s)) / (total + lm.STRENGTH)

    for k in range(1, depth + 1):
        follows = {}
        for w in map(as_symbols, train):
            for i in range(k, len(w)):
                context = tuple(w[i - k : i])
                if other not in context and context[1:] in states:
                    follows.setdefault(context, Counter())[w[i]] += 1
        made = {}
        for context, after in follows.items():
            total = sum(after.values())
            if total < max(n * lm.CONTEXT_SHARE, lm.LEAST_COUNT):
                continue
            least = max(n * lm.ENTRY_SHARE, lm.LEAST_COUNT)
            entries = {s: c for s, c in after.items() if c >= least}
            pooled = total - sum(entries.values())
            gains = []
            for s, c in after.items():
                q = p(context[1:], s)
                if s in entries and c - 1 >= least:
                    x = ((c - 1) + (pooled + lm.STRENGTH) * q) / (total - 1 + lm.STRENGTH) / q
                elif s in entries:
                    x = (pooled + c - 1 + lm.STRENGTH) / (total - 1 + lm.STRENGTH)
                else:
                    x = (pooled - 1 + lm.STRENGTH) / (total - 1 + lm.STRENGTH)
                gains.append((c, math.log(x)))
            if entries and sum(c * x for c, x in gains) > lm.SIGNIFICANCE * math.sqrt(sum(c * x * x for c, x in gains)):
                made[context] = (total, entries)
        if not made:
            break
        states |= made
    out = []
    for _, w in token:
        s = as_symbols(w)
        total = 0.0
        for i, x in enumerate(s):
            context = next(c for k in range(min(depth, i), -1, -1) if (c := tuple(s[i - k : i])) in states)
            total += math.log10(base(w[i])) + math.log10(p(context, x) / top.get(x, rest_of))
        out.append(total)
    return out, states


def test_scores_equal_brute_force_and_model_is_better(docs_of):
    rows = lm_rows()
    token = {d: [*words(lowered(t)), None] for d, t in rows}
    count = Counter()
    for d, w in token.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            count.update(w)
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in lm.score(docs_of(rows, extra=True)).collect()}
    assert len(got) == len(rows)
    expected, states = brute_scores(rows)
    assert {len(c) for c in states} >= {0, 1, 2}
    held = [0.0, 0.0]
    for (d, _), score in zip(rows, expected, strict=True):
        r, w = got[d], token[d]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        if r["held_out"]:
            held[0] += r["base_score"]
            held[1] += r["score"]
    assert held[1] > held[0] + 0.2 * abs(held[0])
    gibberish = got[901]
    assert gibberish["score"] / gibberish["n_tokens"] < held[1] / sum(got[d]["n_tokens"] for d in got if got[d]["held_out"])


def trained(docs):
    model, _ = lm.count_words(docs.select("text"))
    root = docs.sparkSession.sparkContext.broadcast(model)
    parts = docs.select("doc_id", "n_chars", "text").mapInArrow(lambda b: lm.tell_batches(root.value, b), "doc_id long, held_out long, n_tokens long, _known long, _base double, _rare array<long>, _symbols binary")
    return lm.grow(parts.select("_symbols"), model)


def test_words_drawn_by_chance_make_no_states(docs_of):
    rng = random.Random(1)
    vocabulary = [f"v{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(100))) for k in range(300)]
    assert not [x for x in trained(docs_of(rows)).levels if len(x.total) > 1]


def test_model_is_a_distribution(docs_of):
    rows = [(k, "a b a c " * 30 + "b c " * (k % 5)) for k in range(60)]
    model = trained(docs_of(rows))
    assert model.levels
    import numpy as np

    for state_word in range(model.symbols):
        symbol = np.array([x for s in range(model.symbols + 1) for x in (state_word, s)])
        text = np.repeat(np.arange(model.symbols + 1), 2)
        assert model.probabilities(symbol, text)[1::2].sum() == pytest.approx(1)


def test_rare_contexts_are_states_at_any_size(docs_of, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(900)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(100))) for k in range(1000)]
    # Phrases seen 12 times or more, far below the least share of a context among 100,000 tokens.
    rows += [(2000 + k, f"{' '.join(rng.choice(vocabulary) for _ in range(20))} deep{k % 4} sea v{k % 4} diving{k % 4}") for k in range(80)]
    monkeypatch.setattr(lm.suffixtree, "BATCH", 20_000)
    monkeypatch.setattr(lm.suffixtree, "BUCKET", 10_000)
    got = lm.score(docs_of(rows, extra=True)).collect()
    n = got[0]["train_tokens"]
    assert n * lm.CONTEXT_SHARE > 16
    for share in ("SYMBOL_SHARE", "CONTEXT_SHARE", "ENTRY_SHARE"):
        monkeypatch.setattr(lm, share, 0)
    expected, states = brute_scores(rows)
    assert {len(c) for c in states} >= {0, 1, 2} and ("deep1", "sea") in states
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx({d: x for (d, _), x in zip(rows, expected, strict=True)})


@pytest.mark.parametrize("head", [0, 40])
def test_scores_do_not_depend_on_what_reaches_every_task(docs_of, monkeypatch, head):
    docs = docs_of(lm_rows())
    told = [{r["doc_id"]: r["score"] for r in lm.score(docs).collect()}]
    monkeypatch.setattr(lm.suffixtree, "HEAD", head)
    told.append({r["doc_id"]: r["score"] for r in lm.score(docs).collect()})
    assert told[0] == told[1]


def test_shuffles_go_when_a_table_of_the_tree_is_written(docs_of):
    docs = docs_of(lm_rows())
    spark, setting = docs.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = files.getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}

    before, now = shuffles(), spark.conf.get(setting)
    table = lm.suffixtree.settled(docs.repartition(3, "doc_id"), "tree")
    for _ in range(50):  # deletions take a moment
        if shuffles() <= before:
            break
        time.sleep(0.2)
    assert shuffles() <= before and spark.conf.get(setting) == now
    assert table.count() == docs.count()


def test_bounded_tree_of_a_small_corpus_is_the_whole_tree(docs_of):
    docs = docs_of(lm_rows())
    told = [{r["doc_id"]: r["score"] for r in made(docs).collect()} for made in (lm.score, lm.bounded_score)]
    assert told[0] == pytest.approx(told[1])


def test_lm_of_empty_table(docs_of):
    assert lm.score(docs_of([])).collect() == []


def check_packing(rows, got, width=1024):
    from tokenizers import Tokenizer

    import numpy as np

    t = Tokenizer.from_file(packing.default_tokenizer())
    text = dict(rows)
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in text.items()}
    seen, sequences = Counter(), {}
    for r in got:
        own = ids[r["doc_id"]]
        piece = own[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(own) and len(piece) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        seen.update((r["doc_id"], k) for k in range(r["start"], r["start"] + r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == Counter((d, k) for d, _ in rows for k in range(len(ids[d])))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
    return 1 - sum(r["length"] for r in got) / (len(sequences) * width)


def test_packing_is_exact_and_tight(docs_of):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice("ab cdé\n.,0 <|endoftext|>") for _ in range(rng.randint(0, 4000)))) for k in range(120)] + [(500, None), (501, "")]
    assert check_packing(rows, packing.pack(docs_of(rows, extra=True)).collect()) < 0.05
    twice = [(1, "hello there"), (1, "hello there")]
    assert check_packing(twice, packing.pack(docs_of(twice)).collect()) <= 1
    assert packing.pack(docs_of([])).collect() == []


def test_ids_are_the_library_s_with_its_defaults(docs_of):
    from tokenizers import Tokenizer

    import numpy as np

    t, rng = Tokenizer.from_file(packing.default_tokenizer()), random.Random(8)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  \n", "a", "word", "é", "<|"]
    texts = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", *("".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(60))]
    got = {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in packing.pieces(docs_of(list(enumerate(texts))), packing.default_tokenizer()).collect()}
    ids = [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    assert ids[0] == [64, 50256, 65, 0]
    assert got == {k: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids)}


@pytest.mark.parametrize("text", [" " * 5_000_000, "a" * 5_000_000, "#" * 5_000_000, "word" + "\n \t" * 500_000 + "end<|endoftext|>"], ids=["blanks", "letters", "symbols", "mixed"])
def test_texts_of_one_long_run(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    assert packing.encoder(path)(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_a_text_of_blanks_is_packed_with_others(docs_of):
    rows = [(1, " " * 2_000_000), (2, "hello"), (None, "copy"), *[(None, "copy")] * 40]
    got = packing.pack(docs_of(rows)).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 2_000_001
    assert sum(r["doc_id"] is None for r in got) == 41


@pytest.mark.parametrize("seed", range(5))
def test_plan_holds_the_histogram(seed):
    rng = random.Random(seed)
    histogram = dict(Counter(rng.randint(1, 64) for _ in range(rng.choice([1, 30, 3000]))))
    made = packing.plan(histogram, 64)
    held = Counter()
    for lengths, times in made:
        assert sum(lengths) <= 64
        for x in lengths:
            held[x] += times
    assert held == Counter(histogram)
    total = sum(k * n for k, n in histogram.items())
    assert sum(t for _, t in made) <= 1.05 * total / 64 + 12


def test_neighbours_recall_and_odd_rows(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    x[500:900] = x[500]
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32).astype(float))]
    odd = [(20000, None), (20020, [0.0] * 16), (20040, [float("nan")] * 16), (20060, [1.0] * 3), (None, [1.0] * 16), (20080, [None] * 16)]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "2 as b", "3 as g", "4 as _row", "5 as dim", "6 as rank")
    monkeypatch.setattr(ann, "LEAST_BLOCK", 1000)
    got = ann.search(table, sample_rows=1000).collect()
    x = np.array([v for _, v in rows])
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == list(range(0, 3000, 20))
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        scores = x @ x[q]
        scores[q] = -np.inf
        exact = np.lexsort((np.arange(3000), -np.round(scores, 9)))[:20]
        hits += len({r["vec_id"] for r in found} & set(exact.tolist()))
        assert [r["rank"] for r in found] == list(range(1, 21)) and q not in {r["vec_id"] for r in found}
        assert all(r["score"] == pytest.approx(float(x[q] @ x[r["vec_id"]]), abs=1e-9) for r in found)
        assert all((-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"]) for a, b in zip(found, found[1:], strict=False))
    assert hits >= 0.95 * 20 * len(by)


def test_few_neighbours(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(ann.search(table).collect(), key=lambda r: r["rank"])] == [(1, 1, 0.5), (2, 2, -1.0)]
    assert ann.search(table.limit(0)).collect() == []


def test_rows_of_one_id_and_other_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [-1.0, 0.5]), (20, [0.0, 1.0, 0.0]), (3, [0.5, 0.5, 0.5]), (20, [0.0, 1.0, 0.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 1, 1, 0.9), (0, 2, 1, -1.0), *[(20, 1, 20, 1.0)] * 2, *[(20, 2, 3, 0.5)] * 2]


def test_vectors_of_huge_and_tiny_components(spark):
    import numpy as np

    x = np.random.default_rng(4).normal(size=(400, 8))
    x[7], x[13] = 1e200, 1e-300
    got = ann.search(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    with np.errstate(over="ignore"):
        for q in range(0, 400, 20):
            scores = (x * x[q]).sum(1)
            own = sorted(set(range(400)) - {q}, key=lambda k: (-scores[k], k))[:20]
            assert len(set(own) & {r["vec_id"] for r in got if r["query_id"] == q}) >= 18
    assert len(got) == 400


@pytest.mark.parametrize("radius", [0, 1, 5, 17, 40, 64])
def test_probing_finds_every_code_within_the_radius(radius):
    import numpy as np

    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 1 << 16, (500, 4)).astype(np.uint16)
    codes[100:200] = codes[0] ^ (1 << rng.integers(0, 16, (100, 4))).astype(np.uint16)
    index = ann.Index.of(codes)
    for q in (codes[0], codes[150], rng.integers(0, 1 << 16, 4).astype(np.uint16)):
        expected = np.flatnonzero(np.bitwise_count(codes ^ q).sum(1) <= radius)
        assert np.flatnonzero(index.within(q[None, :], radius)[0]).tolist() == expected.tolist()
