import re

import corpus_pipeline
from tessera.llm import _base, registry


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = _base.materialize(stage(spark, docs, sf), "test")
        seen[name] = (docs.count(), out.count())
        if name != "token output":
            assert out.columns == docs.columns
        if name not in ("mixing", "token output"):
            assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        docs = out
    assert seen["quality classifier"][1] < seen["quality classifier"][0] and seen["near-duplicates"][1] < seen["near-duplicates"][0]
    assert seen["token output"][0] == seen["token output"][1]
    assert corpus_pipeline.run(spark, sf).count() == seen["token output"][1]


def test_only_results_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_base, "shared_dir", lambda spark: f"file://{tmp_path}")
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf)
    assert len(list((tmp_path / "tessera").iterdir())) == 1 and rows.count() > 0
    for name in ("op1_media", "op4_near_duplicates", "op7_repeats", "op10_decontaminate"):
        registry.queries()[name](spark, sf).count()
    left = sorted(re.sub("-[0-9a-f]{32}$", "", p.name) for p in (tmp_path / "tessera").iterdir())
    assert left == ["contaminations", "media-index", "media-store", "near-duplicate-rows", "repeats", "stage-token-output"]


def test_stages_on_dirty_rows(spark, dirty):
    sf = "/root/testdata/sf0.001"
    for docs in (dirty, dirty.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert (out.columns == docs.columns or name == "token output") and out.count() <= 2 * docs.count()
