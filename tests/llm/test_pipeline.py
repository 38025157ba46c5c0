"""The pipeline's stages on a small fixture, against what each must keep."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
    left = docs.count()
    assert 0.7 * before < left < before
    assert docs.select("doc_id").distinct().count() == left
    masked = docs.filter("text rlike '(?i)password=[a-z0-9]{6}'").count()
    assert masked == 0


def test_stages_take_odd_rows(spark):
    rows = [(9001, None, None, "s", None), (9002, "", "en", None, 0), (9003, "the and of house", None, "s", 1), (9003, "the and of house", None, "s", 1), (None, "the and of house", "en", "s", 1)]
    base = spark.read.parquet(f"{SF}/documents.parquet")
    docs = base.unionByName(spark.createDataFrame(rows, base.schema))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.filter("doc_id in (9001, 9002)").count() == 0
    pieces = docs.filter("doc_id = 9003").collect()
    assert not pieces or sum(r.length for r in pieces) == pieces[0].doc_tokens
    assert docs.columns[:2] == ["doc_id", "start"]


def test_stages_take_clashing_columns(spark):
    names = ["_lang", "_score", "_row", "spans", "_hit_words", "component_id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", *(f"'{x}!' as `{x}`" for x in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert docs.count() == docs.filter(" and ".join(f"`{x}` = '{x}!'" for x in names)).count() > 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    used = out.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert used and all(r[1] <= 2048 for r in used)
