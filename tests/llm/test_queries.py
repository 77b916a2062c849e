"""Registered corpus queries against DuckDB, held-out accuracy and the pipeline's stages, on the smallest tables."""

import os

import pytest

from factloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", ORACLES)
def test_same_rows_as_duckdb(spark, same_as_duckdb, name):
    same_as_duckdb(QUERIES[name](spark, SF), ORACLES[name], SF)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no larger tables here")
    scored = QUERIES["op5_quality"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert scored.selectExpr("avg(CAST(predicted = quality AS INT)) AS a").first().a > 0.98


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = first = spark.read.parquet(f"{SF}/documents.parquet").withColumn("shard", __import__("pyspark").sql.functions.lit(1))
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == corpus_pipeline.COLUMNS
        counts.append(docs.count())
    good = QUERIES["op5_quality"](spark, SF).where("predicted = 1").count()
    assert counts[0] == counts[1] == good <= first.count()
    groups = QUERIES["op6_simhash_dedup"]
    assert counts[2] <= counts[1] and counts[4] == counts[3] and groups is not None
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def test_pipeline_takes_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
