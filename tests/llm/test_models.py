"""Learned operators by held-out accuracy, and the pipeline against its stages' brute-force versions."""

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from cohesia.llm import decontamination, langid, near_copies, pii, queries

SF = "/root/testdata/sf0.01"


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x["lang_pred"] == x["lang"] for x in rows) >= 0.98 * len(rows)
    assert sum(x["rejected"] for x in rows) <= 0.01 * len(rows)


def test_language_id_on_odd_tables(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34 !?", None), (None, "some words here", None), (4, "some english words here and there", "en"), (4, "some english words here and there", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    assert len(got) == 6 and {x["lang_pred"] for x in got if x["doc_id"] in (1, 2, 3)} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0
    assert {x["lang_pred"] for x in langid.identify(df.where("lang is null")).collect()} == {"und"}


def test_far_texts_are_rejected(spark):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    _, _, rejected = model.predict(["Съешь же ещё этих мягких французских булок да выпей чаю. " * 20, "これは日本語の文章です。" * 30])
    assert rejected == [True, True]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = {x["doc_id"]: x for x in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * len(rows)
    one = {x["doc_id"] for x in stage["near_duplicates"](spark, docs, SF).collect()}
    sets = {d: set(near_copies.shingles(x["text"]).tolist()) for d, x in rows.items()}
    up = {d: d for d in rows}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, x in sets.items():
        for b, y in sets.items():
            if b < a and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                up[max(root(a), root(b))] = min(root(a), root(b))
    assert one == {root(d) for d in rows}
    items = [decontamination.normal(x["text"]) for x in bench.collect()]
    clean = {x["doc_id"] for x in stage["decontamination"](spark, docs, SF).collect()}
    holds = {d for d, x in rows.items() if any(i and i in decontamination.normal(x["text"]) for i in items)}
    assert clean == set(rows) - holds
    detector = pii.train()
    for x in stage["pii"](spark, docs, SF).collect():
        assert x["text"] == pii._replaced(rows[x["doc_id"]]["text"], detector.spans(rows[x["doc_id"]]["text"])) and x["n_chars"] == len(x["text"])
        assert not [s for s in pii.base_spans(x["text"]) if s[2] == "email"]
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == len(one & clean & {x["doc_id"] for x in kept.collect()})


def test_names(spark):
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))
