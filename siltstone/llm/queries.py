"""The registered queries of this subpackage's operators; each keeps its contract's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltstone.llm import decontaminate, imatch, langid, lm, merkle, merkle_sql, mixing, ngram_join, packing, quality, sharding, substring_dedup, suffix_dedup, whitening
from siltstone.llm.work import Work


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(folds))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = sharding.Store(spark, Work(spark, "op1").path)
    store.append(docs, sharding.ARRIVALS)
    version = store.compact(docs.schema)
    return store.rows(docs.schema).select("row.doc_id", "arrival", F.col("file").alias("shard"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"), "tier", F.lit(version).alias("version"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "row.source", "offset", "block", "slot")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Work(spark, "op3"))
    return decontaminate.digest(hits)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), Work(spark, "op4"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.deduplicate(table(spark, sf_dir, "documents"), Work(spark, "op5"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), Work(spark, "op6")
    return imatch.compare_edited(docs, imatch.lexicon(docs, work), work)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out, "quality")
    got = quality.score(docs, model)
    return got.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 1
    got = lm.score(docs, ~held_out, Work(spark, "op8"))
    return got.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), Work(spark, "op9"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = langid.train(docs, ~held_out)
    got = langid.identify(docs, model, ["doc_id"])
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = merkle.leaf([lowered if c == "text" else F.col(c) for c in merkle.FIELDS])
    got = merkle.manifest(docs, Work(spark, "op11"), F.when(fold("doc_id", 3) == 0, tampered))
    return got.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(table(spark, sf_dir, "documents"), Work(spark, "op13"))
    return got.select("doc_id", "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")


def queries() -> dict:
    return {"op1_sharding": op1_sharding, "op2_mixing": op2_mixing, "op3_decontaminate": op3_decontaminate, "op4_ngram_join": op4_ngram_join, "op5_substring_dedup": op5_substring_dedup, "op6_imatch": op6_imatch, "op7_quality": op7_quality, "op8_lm": op8_lm, "op9_suffix_dedup": op9_suffix_dedup, "op10_langid": op10_langid, "op11_merkle_manifest": op11_merkle_manifest, "op12_whitening": op12_whitening, "op13_packing": op13_packing}


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle_manifest": merkle_sql.manifest()}
