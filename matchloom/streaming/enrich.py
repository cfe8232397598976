"""Enrichment over a stream with keyed state: what has a final outcome is remembered, whatever else has come since.

A record's state holds its last status and the number of attempts, so a micro-batch reads the records it was given and
their states, never the table of outcomes. Each micro-batch is a commit: its size is what the source
gives at a time, and what was done before an interruption isn't done again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchloom.operators.enrichment import FINAL

_OUTCOME = "publication_id string, status string, attempt int, body string"


def enriched(records: DataFrame, work: Callable[[dict], tuple[str, str]], order: list[str], final: tuple[str, ...] = FINAL) -> DataFrame:
    """An outcome for each attempt at a streamed record: publication_id, status, attempt, body.

    records: publication_id and what `work` needs of a record; it gives (status, body). Of a record that comes several times, attempts are made in
    the given order until one is final; later ones are passed over. A null id is no record. An error of `work` is `retrieval_error`.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempt = state.get if state.exists else ("", 0)
        if status in final:  # most calls of a long stream: nothing is laid out for them
            return
        out, rows = [], list(frames)  # the rows of one record
        rows = rows[0] if len(rows) == 1 else pd.concat(rows)
        for row in (rows.sort_values(order) if len(rows) > 1 else rows).to_dict("records"):
            if status in final:
                break
            attempt += 1
            try:
                status, body = work(row)
            except Exception as e:  # the record's failure is its outcome
                status, body = "retrieval_error", str(e)
            out.append((key[0], status, attempt, body))
        if out:
            state.update((status, attempt))
            yield pd.DataFrame(out, columns=["publication_id", "status", "attempt", "body"])

    return records.where("publication_id is not null").groupBy("publication_id").applyInPandasWithState(run, _OUTCOME, "status string, attempts int", "append", GroupStateTimeout.NoTimeout)


def into(outcomes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends outcomes to a folder, each once, until what is there now is done."""
    return outcomes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of the records in a folder of Parquet files, so many files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
