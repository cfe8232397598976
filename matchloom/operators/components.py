"""Connected components of a table of links, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import Scratch, tasks

_STATE = ("count(*) as n", "coalesce(sum(cast(xxhash64(u, v) as decimal(38,0))), 0) as h")


def _large(links: DataFrame, few: int) -> DataFrame:
    """Each node links its larger neighbours to the smallest node that it knows."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(few).distinct().coalesce(few)


def _small(links: DataFrame, few: int) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. Links go from larger to smaller."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.coalesce(few).unionByName(least.select("u", F.col("m").alias("v")).coalesce(few)).distinct().coalesce(few)


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) of every node but the roots themselves.

    Alternates star steps until nothing changes: a number of rounds that grows with the logarithm of
    the size, each written to the shared folder, in as many tasks as its links ask for.
    """
    steps = Scratch(scratch.spark)
    now = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = steps.keep(now, "links")
    before = now.selectExpr(*_STATE).first()
    while before["n"]:
        last, steps = steps, Scratch(scratch.spark)
        few = tasks(scratch.spark, before["n"])
        now = steps.keep(_small(_large(now, few), few), "links")
        last.clear()
        after = now.selectExpr(*_STATE).first()
        if after == before:
            break
        before = after
    scratch.paths += steps.paths
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
