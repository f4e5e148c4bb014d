"""The pipeline's learned stages where there is nothing to learn from."""

import pytest

import corpus_pipeline

TEXTS = [(1, "A clean document."), (2, "Ein sauberer Text."), (3, "123 ..."), (4, None), (5, ""), (None, "No id but letters.")]


@pytest.mark.parametrize("lang", [None, "en"])
def test_language_without_labels(spark, lang):
    # the second case labels only texts that have no n-gram
    rows = [(i, t, lang if t == "" else None) for i, t in TEXTS] + [(k, "", lang) for k in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.identify_language(spark, docs, "").select("doc_id").collect()
    assert {r["doc_id"] for r in got} == {1, 2, None}


@pytest.mark.parametrize("labels", [[], [(99, 1), (98, 0)], [(1, None)], [(k, 0) for k in range(1, 6)]])
def test_quality_without_labels(spark, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = corpus_pipeline.classify_quality(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, docs.collect()))
