"""The pipeline's stages on small inputs, and its queries' contract."""

import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert {"pipeline", *corpus_pipeline.queries()} <= names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert set(entry.oracle_sql()) <= names


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF).persist()
        assert out.columns == columns and 0 < out.count() <= kept.count(), name
        kept = out
    mixed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert mixed.count() == kept.count() and mixed.where("taken > 3 * size OR taken < 0").count() == 0


def test_near_duplicates_keep_one_of_each_group(spark):
    text = " ".join(f"word{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, text), (2, text), (3, "a quite different text"), (None, "no id")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
