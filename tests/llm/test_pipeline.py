import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_operators import ALNUM, FOLD, expected_components, expected_hits


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    linked = expected_components(rows)
    rows = [r for r in rows if linked[r[0]][1] == r[0]]
    hits = expected_hits(rows, items)
    want = {d for d, _ in rows if not hits[d][4]}
    got = corpus_pipeline.run(spark, sf)
    assert [c for c in got.columns if c in docs.columns] == docs.columns and {"shard", "version"} <= set(got.columns)
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == want


def test_stages_keep_the_columns(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang_pred", F.lit("x")).withColumn("n_hit", F.lit(1)).withColumn("shard", F.lit(2)).limit(60)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        before = docs.columns
        docs = stage(spark, docs, sf)
        assert docs.columns[: len(before)] == before and (k == 4 or len(docs.columns) == len(before))
    assert docs.count() > 30


def test_empty(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
