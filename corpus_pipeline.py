"""The corpus pipeline: five stages that each call one operator of matchloom.llm.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before it kept and returns
the columns of documents, but for the last, which returns the token ids' digests. Null and empty
texts are kept as far as their copies are dropped; an empty table passes through; extra columns of
documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom import session
from matchloom.llm import op01_bpe, op02_decontaminate, op03_jaccard, op04_exact, op05_toxicity
from matchloom.llm.common import documents, ready


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold."""
    return op05_toxicity.reject(docs, ready(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the smallest id."""
    ready(spark)
    return op04_exact.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more, the one with the smallest id."""
    ready(spark)
    return op03_jaccard.keep_one(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return op02_decontaminate.remove_documents(docs, ready(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document that is left."""
    import public_tokenizers as vocab

    ready(spark)
    return op01_bpe.round_trip(docs, vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: Toxicity is learned and tokens come from a library: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs, begin = documents(spark, sf_dir), session.made()
    for name, stage in STAGES[:-1]:
        docs, path = session.materialise(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
        session.clean(spark, begin, keep=(path,))  # the stage before and what this one has written on its way
    return STAGES[-1][1](spark, docs, sf_dir)
