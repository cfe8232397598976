"""What the operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from matchloom import session

#: Records in an Arrow batch: texts can be long, and a batch is held in a Python worker's memory.
BATCH_ROWS = 512


def ready(spark: SparkSession) -> SparkSession:
    """Ships the package and bounds Arrow batches."""
    session.ship(spark)
    session.shared_dir(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


def map_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInArrow for a generator function over record batches."""
    return df.mapInArrow(f, schema)


def no_clash(keep: tuple[str, ...], *made: str) -> None:
    """Columns that are kept must not be named like those that are made."""
    if both := sorted(set(keep) & set(made)):
        raise ValueError(f"columns named like results: {both}")


def texts(column: pa.Array) -> list[str]:
    """Python strings; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)
