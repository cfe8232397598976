"""Session defaults and the places a job may write to."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Paths of intermediate tables, in the order they were made.
MADE: list[str] = []


def get_session(app: str = "matchloom", cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is tuned for (a cluster brings its own)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new local one where that is unset (tests, local mode)."""
    ctx = spark.sparkContext
    found = ctx.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not ctx.master.startswith("local[") and ctx.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(ctx, "_matchloom_shared", None) or f"file://{tempfile.mkdtemp(prefix='matchloom-')}"
        ctx._matchloom_shared = found
    if ctx._jsc.sc().getCheckpointDir().isEmpty():
        ctx.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/matchloom/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(spark: SparkSession, df, name: str, rows: int = 0):
    """Write df in the shared folder and read it back: cuts the lineage, survives lost executors.

    rows: a file's rows at most (0: no such bound). A reading task takes some 30 files at most, as Spark counts the opening of each for 4 MB.

    In local mode without spark.checkpoint.dir the folder is a temporary one of this machine.
    """
    path = scratch(spark, name)
    MADE.append(path)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def tasks(spark: SparkSession, rows: int, each: int = 200_000) -> int:
    """Tasks for so many rows, to coalesce to: each task of a stage leaves files of its own, however few rows it has."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // each))


def made() -> int:
    """How many intermediate tables there have been, for `clean`."""
    return len(MADE)


def clean(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Delete the intermediate tables made since then, but those to keep: for when what reads them is written."""
    for path in MADE[since:]:
        if path not in keep:
            remove(spark, path)
    MADE[since:] = [p for p in MADE[since:] if p in keep]


class Scratch:
    """Intermediate tables of one operator, deleted together when its result no longer reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df, name: str):
        """df written and read back; the shuffle files of what made it can go."""
        df, path = materialise(self.spark, df, name)
        self.paths.append(path)
        release(self.spark)
        return df

    def clear(self) -> None:
        while self.paths:
            remove(self.spark, self.paths.pop())


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that are over: it does so when the driver finds them unreachable."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, wherever the driver was started."""
    ctx = spark.sparkContext
    if ctx.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="matchloom-pkg-"), "matchloom_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.join("matchloom", os.path.relpath(full, root)))
    ctx.addPyFile(path)
    _SHIPPED.add(ctx.applicationId)
