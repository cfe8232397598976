"""Top-k, gates with an early stop, and other window-shaped ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1; `order` must be total."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def best(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, group, order, 1, "__best").drop("__best")


def home_or_fallback(pool: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The k best of a group's home rows, or of all its rows where none is at home; status tells which, and whether home has fewer than k."""
    w = Window.partitionBy(group)
    some = pool.withColumn("some", F.bool_or("home").over(w)).where(F.col("home") == F.col("some")).withColumn("pool_n", F.count("*").over(w))
    status = F.when(~F.col("some"), "university_fallback_ranked").when(F.col("pool_n") < k, "limited_internal_pool").otherwise("home_department_ranked")
    return top_k(some.withColumn("status", status), [group], order, k)


def gated_top_k(df: DataFrame, group: list[str], order: list[Column], passed: Column, k: int, factor: int = 3) -> DataFrame:
    """The first factor * k rows of each group, examined in order until k have passed.

    `examined` rows carry pre_rank, passed, and final_rank of those that passed.
    """
    w = Window.partitionBy(*group).orderBy("pre_rank")
    seen = top_k(df, group, order, factor * k, "pre_rank").withColumn("passed", passed)
    before = F.coalesce(F.sum(F.col("passed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    examined = seen.withColumn("__before", before).where(F.col("__before") < k)
    return examined.withColumn("final_rank", F.when(F.col("passed"), F.col("__before") + 1)).drop("__before")


def rank_problems(df: DataFrame, group: str, rank: str, score: str) -> DataFrame:
    """Groups whose ranks aren't 1 to n, or whose scores rise along them."""
    w = Window.partitionBy(group).orderBy(rank)
    marked = df.select(group, (F.row_number().over(w) != F.col(rank)).alias("gap"), (F.lag(score).over(w) < F.col(score)).alias("rise"))
    return marked.groupBy(group).agg(F.max(F.coalesce("gap", F.lit(True))).alias("rank_gap"), F.max(F.coalesce("rise", F.lit(False))).alias("score_rise"))


def repeated_pairs(df: DataFrame, group: str, a: str, b: str, order: str) -> DataFrame:
    """Second and later rows of an unordered pair within a group."""
    w = Window.partitionBy(group, F.least(a, b), F.greatest(a, b)).orderBy(order)
    return df.withColumn("copy", F.row_number().over(w)).where("copy > 1")


def stratified(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group in an order drawn from the seed (the sampling operator)."""
    return top_k(df, [group], [F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.col(key)], n, "draw")


def quotas(df: DataFrame, item: str, labels: dict[str, tuple[Column, int]], order: list[Column]) -> DataFrame:
    """Each item under the first label that it fits, and of each label no more than its quota, in order."""
    label = None
    for name, (fits, _) in reversed(labels.items()):
        label = F.when(fits, name) if label is None else F.when(fits, name).otherwise(label)
    quota = None
    for name, (_, n) in labels.items():
        quota = F.when(F.col("label") == name, n) if quota is None else quota.when(F.col("label") == name, n)
    found = df.withColumn("label", label).where("label is not null")
    w = Window.partitionBy("label").orderBy(*order)
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= quota)


def interleaved(df: DataFrame, flag: Column, order: list[Column], n: int) -> DataFrame:
    """n rows that alternate between those with the flag and those without, then whatever is left."""
    w = Window.partitionBy("__flag").orderBy(*order)
    sides = df.withColumn("__flag", F.coalesce(flag, F.lit(False)))
    # each side gives n rows at most before the two are put in one order
    turns = sides.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return turns.withColumn("flagged", F.col("__flag")).drop("__flag").orderBy("turn", F.desc("flagged")).limit(n)
