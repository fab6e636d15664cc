"""The pipeline, stage by stage, against what each stage must have done."""

import zlib

import corpus_pipeline
import numpy as np

from tests.llm.test_operators import brute_base, brute_near, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def junk(text):
    words = text.split()
    repeated = sum(a == b for a, b in zip(words, words[1:])) > 0.2 * len(words)
    return repeated or "!!" in text or "$$$" in text or " | " in text


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "neardup", "substring", "pii", "packing"]


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = before = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, sf)
        if name != "packing":
            assert out.columns == before.columns and out.schema == before.schema
        seen[name] = {r.doc_id: r for r in out.collect()} if name != "packing" else out.collect()
        docs = out
    start = {r.doc_id: r.text for r in before.collect()}
    kept = seen["quality"]
    assert np.mean([i in kept for i, t in start.items() if not junk(t)]) > 0.9
    brute = {i for i, _, c, _ in brute_near([(i, r.text) for i, r in kept.items()], 3, 85) if i == c}
    assert set(seen["neardup"]) == brute
    for i, r in seen["substring"].items():
        assert r.n_chars == len(r.text) <= len(start[i])
    for i, r in seen["pii"].items():
        assert not brute_base(r.text)
    assert {r.doc_id for r in seen["packing"]} == set(seen["pii"])
    run = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in run) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in seen["packing"])


def test_clean_documents_stay(spark):
    clean = {i: prose(1000 + i, 120) for i in range(30)}
    docs = documents(spark, {**clean, 50: clean[3], 51: None, 52: ""})
    out = docs
    for name in ("neardup", "substring", "pii"):
        out = stage(name)(spark, out, "/root/testdata/sf0.001")
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {**clean, 51: None, 52: ""}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def test_quality_filter_rejects_junk(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in stage("quality")(spark, docs, sf).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(i in kept) == (truth[i] == 1) for i in held]) > 0.95
