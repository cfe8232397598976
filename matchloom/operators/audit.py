"""Counts of what is there, missing, repeated or dangling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import is_blank


def coverage(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """field, available, missing, percent of each field; one pass."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(~blank).alias(f"f{i}") for i, blank in enumerate(fields.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"f{i}").alias("available")) for i, k in enumerate(fields)])).alias("r")
    return counts.select("n", rows).select("r.field", "r.available", (F.col("n") - F.col("r.available")).alias("missing"), F.round(F.when(F.col("n") == 0, 0.0).otherwise(100.0 * F.col("r.available") / F.col("n")), 2).alias("percent"))


def blanks(df: DataFrame, columns: list[str]) -> DataFrame:
    return coverage(df, {c: is_blank(F.col(c).cast("string")) for c in columns}).select("field", F.col("missing").alias("blank"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Values that occur more than once, with their number."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def excess(df: DataFrame, key: str) -> DataFrame:
    """One row: how many rows are one too many."""
    return duplicates(df, key).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))


def dangling(checks: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """check, missing: distinct keys of the first table that the second lacks."""
    found = [
        child.select(F.col(c).alias("k")).where("k is not null").distinct().join(parent.select(F.col(p).alias("k")), "k", "left_anti").agg(F.lit(name).alias("check"), F.count("*").alias("missing"))
        for name, (child, c, parent, p) in checks.items()
    ]
    return reduce(DataFrame.unionByName, found)


def consolidated(summaries: dict[str, DataFrame]) -> DataFrame:
    """report, metric, value: the numbers of several one-row summaries under each other."""
    rows = []
    for name, df in summaries.items():
        metrics = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
        rows.append(df.select(F.lit(name).alias("report"), F.explode(metrics).alias("m")).select("report", "m.*"))
    return reduce(DataFrame.unionByName, rows)


def categories(df: DataFrame, values: Column) -> DataFrame:
    """value, n over a column of arrays."""
    return df.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: each rule's outcome over all rows, and whether all hold."""
    each = df.agg(*[F.coalesce(F.bool_and(c), F.lit(True)).alias(k) for k, c in rules.items()])
    return each.withColumn("valid", reduce(lambda a, b: a & b, [F.col(k) for k in rules]))


def summary(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(group or [])).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def histogram(df: DataFrame, value: Column, bounds: list[float]) -> DataFrame:
    """band, n: bands are [previous, bound), the last is open."""
    edges = [0.0, *bounds]
    band = None
    for a, b in zip(edges, bounds):
        label = f"{a:g}-{b:g}"
        band = F.when(value < b, label) if band is None else band.when(value < b, label)
    return df.groupBy(band.otherwise(f">={bounds[-1]:g}").alias("band")).agg(F.count("*").alias("n"))
