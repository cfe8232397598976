"""The incremental side: records that come in are enriched once, and state says which are done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from matchloom.operators.enrichment import FINAL, cached, pending


def resume(publications: DataFrame, done_path: str, work: Callable[[DataFrame], DataFrame], batch: int | None = None) -> int:
    """Does what isn't done and appends the outcome; returns how many records were taken."""
    spark = publications.sparkSession
    try:
        done = spark.read.parquet(done_path).select("publication_id", "status")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], "publication_id string, status string")
    todo = pending(publications, done, batch).persist()
    n = todo.count()
    if n:
        work(todo).write.mode("append").parquet(done_path)
    todo.unpersist()
    return n


def stream(source: DataFrame, done_path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """The same over a stream of publications: whatever is available, in micro-batches, each enriched at most once."""

    def each(batch: DataFrame, _: int) -> None:
        resume(batch.dropDuplicates(["publication_id"]), done_path, work)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["FINAL", "cached", "resume", "stream"]
