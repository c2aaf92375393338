"""The corpus pipeline: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.llm import decontaminate, langid, mixing, ngram_join, sharding
from siltstone.llm.work import Work


def _aside(docs: DataFrame) -> DataFrame:
    """The documents with all columns renamed that no operator reads, so none clashes with an operator's own."""
    return docs.toDF(*[c if c in ("doc_id", "text", "lang", "source") else f"_{k}" for k, c in enumerate(docs.columns)])


def _free(name: str, docs: DataFrame) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text in any language go; a missing language is filled in."""
    model = langid.train(docs, F.lit(True))
    rows = _aside(docs)
    got = langid.identify(rows, model, rows.columns).filter("lang_pred != 'und'")
    return got.select(*[F.coalesce("lang", "lang_pred").alias(c) if c == "lang" else F.col(c) for c in rows.columns]).toDF(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    found = ngram_join.near_duplicates(docs, Work(spark, "stage-ngram-join"))
    return docs.join(found.filter("component_id < doc_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _aside(docs)
    hits = decontaminate.decontaminate(rows, tests, Work(spark, "stage-decontaminate"), keep=rows.columns)
    return hits.filter("n_hit = 0").select(*rows.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, in the order of the mix."""
    return mixing.in_mix_order(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, each with its shard and place."""
    store = sharding.Store(spark, Work(spark, "stage-shards").path)
    store.append(docs, sharding.ARRIVALS)
    version = store.compact(docs.schema)
    return store.rows(docs.schema).select("row.*", F.col("file").alias(_free("shard", docs)), F.col("rows").alias(_free("shard_rows", docs)), F.lit(version).alias(_free("version", docs)))


STAGES = [
    ("language ID", identify_languages),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", remove_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: SQL has no form for the language model, the schedule and the shards.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Work(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k > 1:
            work.drop(f"stage-{k - 2}")
    return docs
