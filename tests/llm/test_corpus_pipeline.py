"""The stages in order, each on its predecessor's output."""

import re

import corpus_pipeline
from veracity.llm.quality_rules import assess

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORDS.findall((text or "").lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_stages_take_effect_and_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
            assert docs.where("n_chars <> length(text)").count() == 0
    before, after = seen["quality_rules"]
    kept = {r.doc_id for r in assess(before).where("quality.kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept
    before, after = seen["jaccard_join"]
    sets = [s for s in (shingles(r.text) for r in after.collect()) if s]
    for i, a in enumerate(sets):
        assert all(100 * len(a & b) < 80 * len(a | b) for b in sets[:i])
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i and i <= shingles(r.text) for r in seen["decontamination"][1].collect() for i in items)
    before, packed = seen["packing"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, packed.collect()))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in before.collect()}


def test_stages_bear_an_empty_table(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0
