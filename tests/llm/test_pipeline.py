import random

import corpus_pipeline


def test_stages_take_effect(spark, docs_of, tmp_path):
    rng = random.Random(5)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passage = fresh(120)
    rows = [(k, fresh(200), "en", f"s{k % 3}") for k in range(40)]
    rows += [(50, "too short", "en", "s0"), (51, "x y z " * 80, "en", "s1"), (52, None, None, None)]
    rows += [(60 + k, rows[k][1], "en", "s0") for k in range(5)]
    rows += [(70, fresh(100) + " " + passage + " " + fresh(100), "en", "s1"), (71, fresh(100) + " " + passage + " " + fresh(100), "en", "s2")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
        seen[name] = docs.collect()
    ids = [{r["doc_id"] for r in rows} for rows in seen.values()]
    assert ids[0] == set(range(40)) | set(range(60, 65)) | {70, 71}
    assert ids[1] == set(range(40)) | {70, 71}
    cut = {r["doc_id"]: r for r in seen["suffix-array dedup"]}
    assert ids[2] == ids[1] and all(passage not in r["text"] and r["n_chars"] == len(r["text"]) for r in cut.values())
    mixed = seen["mixing sources to target weights"]
    assert all(r["text"] == cut[r["doc_id"]]["text"] for r in mixed)
    got = seen["packing"]
    assert sum(r["length"] for r in got) == sum(next(g["doc_tokens"] for g in got if g["doc_id"] == r["doc_id"]) for r in mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got)


def test_stages_keep_clashing_columns_and_cut_passages_of_fifty_words(spark, docs_of, tmp_path):
    rng = random.Random(6)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passages = [fresh(n) for n in (51, 53, 56, 60)]
    rows = [(k, f"{fresh(90)} {passages[k % 4]} {fresh(90)}", "en", f"s{k % 3}") for k in range(24)] + [(None, fresh(120), "en", None), (None, fresh(130), "en", None), (30, None, None, None), (31, "", None, "s1")]
    docs = docs_of(rows, extra=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == names
        if name == "suffix-array dedup":
            texts = [r["text"] for r in docs.collect()]
            assert docs.count() == before == 26 and not any(" ".join(p.split()[k : k + 45]) in t for t in texts for p in passages for k in range(len(p.split()) - 44))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_pipeline_of_no_documents(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_texts_meet_python_in_small_batches(spark, docs_of, monkeypatch):
    from tessella.llm import quality, stage

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(stage, "ROWS", 7)
    real, sizes = quality.blocks, spark.sparkContext.accumulator(0)

    def counted(column, *how):
        if len(column) > 7:
            sizes.add(1)
        return real(column, *how)

    monkeypatch.setattr(quality, "blocks", counted)
    try:
        docs = docs_of([(k, "a few words " * 5 + f"{k}", "en", "s") for k in range(100)]).coalesce(1)
        quality.accepted(docs).collect()
        assert sizes.value == 0
        spark.conf.set(name, "3")
        quality.accepted(docs).collect()
        assert spark.conf.get(name) == "3"
    finally:
        spark.conf.set(name, before)
