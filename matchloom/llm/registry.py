"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import op01_bpe, op02_decontaminate, op03_jaccard, op04_exact, op05_toxicity, op06_binary, op07_counts, op08_maxent, op09_pii, op10_quality
from matchloom.llm import op11_minhash as minhash
from matchloom.llm import op12_fim as fim
from matchloom.llm import op13_whitening as whitening
from matchloom.llm.common import documents, ready


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    return op01_bpe.round_trip(documents(spark, sf_dir), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op02_decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_jaccard.classes(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_exact.exact_groups(documents(spark, sf_dir), digest=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(op05_toxicity.fold_of("doc_id", 4) != 2)
    scored = op05_toxicity.score(docs, op05_toxicity.learn(docs, labels))
    return scored.select("doc_id", (op05_toxicity.fold_of("doc_id", 4) == 2).alias("held_out"), "score", F.expr("if(score >= 0.3, 1, 0)").alias("predicted"))


def op6_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    return op06_binary.checksums(op06_binary.write_and_read(documents(spark, sf_dir), vocab.path("byte_bpe_50k.json"), end_id=2))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    counted = op07_counts.count_tokens(documents(spark, sf_dir), vocab.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op8_lm_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return op08_maxent.score(docs, op05_toxicity.fold_of("doc_id", 5) == 1)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return op09_pii.find(docs, op09_pii.learn(docs))


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(op05_toxicity.fold_of("doc_id", 5) != 0)
    scored = op10_quality.score(docs, op10_quality.learn(docs, labels))
    return scored.select("doc_id", (op05_toxicity.fold_of("doc_id", 5) == 0).alias("held_out"), "score", F.expr("if(score >= 0.3, 1, 0)").alias("predicted"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(documents(spark, sf_dir), n=4)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(ready(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_decontaminate, op3_jaccard, op4_exact_dedup, op5_toxicity, op6_binary, op7_token_counts, op8_lm_maxent, op9_pii, op10_quality_crf, op11_minhash, op12_fim, op13_whitening)}
ORACLES = {"op2_decontaminate": op02_decontaminate.ORACLE, "op3_jaccard": op03_jaccard.ORACLE, "op4_exact_dedup": op04_exact.ORACLE, "op11_minhash": minhash.ORACLE, "op12_fim": fim.ORACLE}
