"""The pipeline's stages on a small corpus with planted cases."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").first().text
    clean = docs.orderBy("n_chars", ascending=False).first().text
    planted = [(9000, clean + " tail"), (9001, item), (9002, "12345 67890 !!!"), (9003, None)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in planted], docs.schema))
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.cut(stage(spark, docs, "/root/testdata/sf0.001"))
        seen[name] = docs
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert not {9002, 9003} & ids["language_id"] and 9000 in ids["language_id"]
    assert 9000 not in ids["near_duplicates"] and 9001 not in ids["decontamination"]
    assert ids["private_data"] == ids["decontamination"] == ids["best_fit_packing"]
    assert seen["best_fit_packing"].groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
