"""Operator 7: token counts through a digest cache.

A text's content digest (SHA-256 of its UTF-8; null is normalised to the empty text, nothing else is
changed, for anything else could change a count) and the tokenizer's version digest key a stored
table of counts. Only distinct texts that the table lacks are encoded, once each, and appended to
it; then every row finds its count there. Copies of a text are dropped where they are read, before
the shuffle, so a text that a third of all rows share costs one row a task. Repeated rows each get
their row; an empty table gives an empty result; extra columns are dropped unless named in `keep`.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm import tokens
from matchloom.llm.common import no_clash
from matchloom.session import scratch

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def _digest(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _first_seen(batches):
    """digest, text -> digest, size, packed text, of each digest that the task hasn't seen."""
    seen: set[bytes] = set()
    for b in batches:
        digests, packed, sizes = [], [], []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if d not in seen:
                seen.add(d)
                raw = (t or "").encode()
                digests.append(d)
                sizes.append(len(raw))
                packed.append(pa.compress(raw, "zstd", asbytes=True) if raw else b"")
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["digest", "size", "packed"])


def _encode(path: str):
    def run(batches):
        encoder, seen = tokens.load(path), set()
        for b in batches:
            digests, counts = [], []
            for d, n, p in zip(*(c.to_pylist() for c in b.columns)):
                if d not in seen:
                    seen.add(d)
                    digests.append(d)
                    counts.append(encoder.count(pa.decompress(p, n, "zstd", asbytes=True).decode()) if n else encoder.count(""))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def read_cache(spark, cache_path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def fill_cache(docs: DataFrame, tokenizer: str, cache_path: str, text: str = "text") -> None:
    """Encodes the distinct texts that the cache lacks and appends their counts."""
    spark, version = docs.sparkSession, tokens.version(tokenizer)
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest")
    once = docs.select(_digest(text).alias("digest"), F.col(text)).mapInArrow(_first_seen, "digest binary, size long, packed binary")
    once = once.repartition("digest")
    if not known.isEmpty():
        once = once.join(known, "digest", "left_anti").select("digest", "size", "packed")
    counts = once.mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
    counts.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, n_bytes and n_tokens of every row. Without a cache_path the cache is this call's own."""
    no_clash(keep, "n_bytes", "n_tokens", "digest", "__digest")
    spark = docs.sparkSession
    cache_path = cache_path or scratch(spark, "token-counts")
    fill_cache(docs, tokenizer, cache_path, text)
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == tokens.version(tokenizer))
    known = known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # writers at the same time may store a text twice
    keyed = docs.select(*keep, _digest(text).alias("__digest"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"))
    return keyed.join(known, F.col("__digest") == F.col("digest")).select(*keep, "n_bytes", "n_tokens")
