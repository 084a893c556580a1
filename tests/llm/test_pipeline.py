import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from invoicelake.llm import queries


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    base.write.parquet(f"{path}/documents.parquet")
    base.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 50 == 0).cast("int").alias("toxic")).write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert (out.columns == columns) == (name != "packing")
        docs = corpus_pipeline.Scratch(spark, "t").store(out)
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_near_copies_leave_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.without_near_copies(spark, docs, folder)
    ids = {r["doc_id"] for r in kept.collect()}
    classes = corpus_pipeline.set_join.near_duplicate_classes(docs, size=5, percent=80).collect()
    assert {r["component_id"] for r in classes} == ids


def test_every_operator_is_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
