"""Retrieval metrics, agreement, confidence intervals and paired tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Categories of ratings at most; more is a mistaken column, and an error.
MOST_CATEGORIES = 1_000


def marked(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """rows (query, item) with `known`: true where the truth has the pair."""
    return rows.join(truth.select("query", "item").distinct().withColumn("known", F.lit(True)), ["query", "item"], "left")


def relevance(own: float = 0.30) -> Column:
    """2 of a marked row that the truth has, 1 if its own score reaches `own`, else 0."""
    return F.when(F.col("known"), 2).when(F.col("score") >= own, 1).otherwise(0)


def graded(ranked: DataFrame, truth: DataFrame, own: float = 0.30) -> DataFrame:
    """rel of each ranked row (query, item, rank, score): 2 if the truth has it, 1 if its own score reaches `own`, else 0."""
    return marked(ranked, truth).withColumn("rel", relevance(own)).drop("known")


def metrics(rel: DataFrame, k: int = 5, threshold: int = 1) -> DataFrame:
    """query, dcg, ndcg, precision, rr, ap, hit, mean_rel at k of rows (query, rank, rel); the ideal order is that of the rows themselves."""
    top = rel.where(F.col("rank") <= k)
    w = Window.partitionBy("query")
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1.0
    hit = (F.col("rel") >= threshold).cast("int")
    each = (
        top.withColumn("ideal", F.row_number().over(w.orderBy(F.desc("rel"), "rank"))).withColumn("hit", hit)
        .withColumn("hits", F.sum("hit").over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    )
    out = each.groupBy("query").agg(
        F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum(gain / F.log2(F.col("ideal") + 1.0)).alias("idcg"), F.avg("hit").alias("precision"),
        F.coalesce(1.0 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))) / F.sum("hit"), F.lit(0.0)).alias("ap"), F.max("hit").cast("double").alias("hit_rate"), F.avg("rel").alias("mean_rel"),
    )
    return out.withColumn("ndcg", F.when(F.col("idcg") == 0, 0.0).otherwise(F.col("dcg") / F.col("idcg"))).drop("idcg")


def cohen_kappa(ratings: DataFrame, a: str, b: str, weights: str = "none") -> DataFrame:
    """One row: observed (share of equal ratings) and kappa; weights none, linear or quadratic over the ratings' range."""
    cells = ratings.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    if (n := cells.agg(F.greatest(F.count_distinct("a"), F.count_distinct("b"))).first()[0]) > MOST_CATEGORIES:
        raise ValueError(f"{n} categories, {MOST_CATEGORIES} are allowed")
    size = cells.agg(F.sum("n").alias("total"), (F.greatest(F.max("a"), F.max("b")) - F.least(F.min("a"), F.min("b"))).alias("range"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    # a row for each pair of categories: as many as there are categories squared
    grid = left.join(F.broadcast(right), F.lit(True)).join(cells, ["a", "b"], "left").join(F.broadcast(size), F.lit(True)).fillna(0, ["n"])
    far = F.abs(F.col("a") - F.col("b")) / F.greatest("range", F.lit(1))
    cost = (F.col("a") != F.col("b")).cast("double") if weights == "none" else far if weights == "linear" else far * far
    t = F.col("total")
    sums = grid.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0) / t).alias("observed"), F.sum(cost * F.col("n") / t).alias("seen"), F.sum(cost * F.col("na") * F.col("nb") / (t * t)).alias("chance"))
    return sums.select("observed", F.when(F.col("chance") == 0, 1.0).otherwise(1.0 - F.col("seen") / F.col("chance")).alias("kappa"))


def fleiss_kappa(votes: DataFrame, item: str, category: str, n: str = "n") -> DataFrame:
    """One row: kappa of counts of raters (the same number, two or more, for every item) by item and category."""
    per = votes.groupBy(item).agg(F.sum(n).alias("raters"), F.sum(F.col(n) * F.col(n)).alias("squares"))
    agree = per.agg(F.avg((F.col("squares") - F.col("raters")) / (F.col("raters") * (F.col("raters") - 1))).alias("seen"), F.sum("raters").alias("all"))
    share = votes.groupBy(category).agg(F.sum(n).alias("__votes")).join(F.broadcast(agree), F.lit(True)).agg(F.sum(F.pow(F.col("__votes") / F.col("all"), 2)).alias("chance"))
    return agree.join(F.broadcast(share), F.lit(True)).select(F.when(F.col("chance") == 1, 1.0).otherwise((F.col("seen") - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"))


def bootstrap(values: np.ndarray, draws: int = 2000, level: float = 0.95, seed: int = 42) -> tuple[float, float, float]:
    """(mean, lower, upper) of the mean by percentiles of resamples."""
    v = np.asarray(values, float)
    if not len(v):
        return 0.0, 0.0, 0.0
    r = np.random.default_rng(seed)
    means = np.array([v[r.integers(0, len(v), len(v))].mean() for _ in range(draws)])
    return float(v.mean()), float(np.percentile(means, 50 * (1 - level))), float(np.percentile(means, 50 * (1 + level)))


def confidence(df: DataFrame, group: list[str], value: str, draws: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """group, mean, lower, upper: percentiles of resampled means. Every row is drawn a Poisson number of times where it is read, so only sums of draws are exchanged."""
    ddl = ", ".join(f"`{g}` {dict(df.dtypes)[g]}" for g in group)

    def resample(frames):
        r = np.random.default_rng([seed, TaskContext.get().partitionId()])
        sums: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for key, part in frame.groupby(group, dropna=False):
                got = sums.setdefault(key, np.zeros((2, draws)))
                for v in np.array_split(part[value].to_numpy(float), -(-len(part) // 2_000)):
                    times = r.poisson(1.0, (draws, len(v)))
                    got += [times @ v, times.sum(1)]
        for key, (total, n) in sums.items():
            yield pd.DataFrame({**{g: [k] * draws for g, k in zip(group, key)}, "draw": np.arange(draws), "total": total, "n": n})

    rows = df.select(*group, value).where(F.col(value).isNotNull())
    drawn = rows.mapInPandas(resample, f"{ddl}, draw int, total double, n double").groupBy(*group, "draw").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    ends = drawn.groupBy(*group).agg(F.percentile("m", (1 - level) / 2).alias("lower"), F.percentile("m", (1 + level) / 2).alias("upper"))
    return rows.groupBy(*group).agg(F.avg(value).alias("mean")).join(ends, group).select(*group, "mean", "lower", "upper")


# ---- paired tests, without a statistics library ----------------------------------------------------


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            n = 1.0
        elif i % 2 == 0:
            n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + n * d, 1e-300) if 1 + n * d > 0 else 1 / (1 + n * d or 1e-300)
        c = 1 + n / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def _moments(d: np.ndarray, k: np.ndarray) -> tuple[int, float, float]:
    """Number, mean and population deviation of values d that occur k times."""
    n = int(k.sum())
    mean = float((d * k).sum() / n)
    return n, mean, math.sqrt(float((k * (d - mean) ** 2).sum() / n))


def t_test(d: np.ndarray, k: np.ndarray | None = None) -> tuple[float, float]:
    """(t, two-sided p) of paired differences d that occur k times."""
    n, mean, s = _moments(d, np.ones(len(d)) if k is None else k)
    if s == 0 or n < 2:
        return 0.0, 1.0 if mean == 0 else 0.0
    t = mean / (s / math.sqrt(n - 1))
    return float(t), beta_inc((n - 1) / 2, 0.5, (n - 1) / (n - 1 + t * t))


def wilcoxon(d: np.ndarray, k: np.ndarray | None = None) -> tuple[float, float]:
    """(smaller rank sum, two-sided p): exact to 25 differences without ties, else by the normal curve."""
    k = (np.ones(len(d)) if k is None else k)[d != 0]
    d = d[d != 0]
    n = int(k.sum())
    if not n:
        return 0.0, 1.0
    size, at = np.unique(np.abs(d), return_inverse=True)
    counts = np.bincount(at, weights=k)
    ranks = np.cumsum(counts) - (counts - 1) / 2
    plus = float((ranks[at] * k)[d > 0].sum())
    w = min(plus, n * (n + 1) / 2 - plus)
    if n <= 25 and (counts == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return w, float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - float((counts**3 - counts).sum()) / 48
    return w, math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(var) / math.sqrt(2))


def tested(d: np.ndarray, k: np.ndarray, base: float, alpha: float = 0.05) -> dict:
    """A paired test of differences d that occur k times: t-test where they look normal, else signed ranks; effect size and gain on the mean `base`."""
    from matchloom.operators.reliability import shapiro

    normal = bool(k.sum() >= 3 and np.ptp(d) > 1e-12 and shapiro(np.repeat(d, k.astype(int)))[1] > 0.05)
    stat, p = t_test(d, k) if normal else wilcoxon(d, k)
    n, mean, s = _moments(d, k)
    s = s * math.sqrt(n / (n - 1)) if n > 1 else 0.0
    return {"test": "paired_t" if normal else "wilcoxon", "statistic": stat, "p_value": p, "cohens_d": mean / s if s else 0.0, "gain_pct": 100 * mean / max(1e-6, base), "significant": bool(p < alpha)}


def paired_test(a: np.ndarray, b: np.ndarray, alpha: float = 0.05) -> dict:
    """Whether b differs from a."""
    d = np.asarray(b, float) - np.asarray(a, float)
    return tested(d, np.ones(len(d)), float(np.mean(a)), alpha)


def compare(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """A paired test a group, from sums: see reliability.compare."""
    from matchloom.operators import reliability

    return reliability.compare(df, group, a, b)
