"""Whether models differ: normality, paired tests and confidence intervals from counted values, for any number of queries.

A group's differences are counted, and what a test needs of their order comes from global ranks: rows are
range-partitioned, sums before a partition come from one row a partition and group, sums within it from a
window. Only sums a group reach the test itself.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators import evaluation as E
from matchloom.session import materialise

_NORMAL = NormalDist()
#: Order statistics summed one by one at each end; between them their sum is an integral, to within rounding.
EXACT = 2_000
#: The coefficients of Royston's approximation (1995), lowest power first.
_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_C3 = (0.544, -0.39978, 0.025054, -6.714e-4)
_C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
_C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
_C6 = (-0.4803, -0.082676, 0.0030302)
_G = (-2.273, 0.459)


def _poly(c: Sequence[float], x: float) -> float:
    return sum(v * x**i for i, v in enumerate(c))


def quantiles(u: np.ndarray) -> np.ndarray:
    """Of the normal distribution."""
    return np.array([_NORMAL.inv_cdf(x) for x in np.asarray(u, float).ravel().tolist()])


def _density(z: float) -> float:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def scores_between(first: int, last: int, n: int) -> float:
    """Sum of the expected normal order statistics (Blom) of ranks first to last of n."""
    if last < first:
        return 0.0
    at = lambda i: (i - 0.375) / (n + 0.25)
    low, high = max(first, EXACT + 1), min(last, n - EXACT)
    total = 0.0
    if high - low > 1_000:  # midpoint rule: the integral over a half more on both sides, less a twenty-fourth of the slopes' difference
        a, b = (_NORMAL.inv_cdf(at(x)) for x in (low - 0.5, high + 0.5))
        total += (n + 0.25) * (_density(a) - _density(b)) - (1 / _density(b) - 1 / _density(a)) / (n + 0.25) / 24
        ends = [*range(first, low), *range(high + 1, last + 1)]
    else:
        ends = range(first, last + 1)
    return total + float(quantiles(at(np.array(ends, float))).sum()) if len(ends) else total


def squares(n: int) -> float:
    """Sum of the squares of all expected normal order statistics of n."""
    at = lambda i: (i - 0.375) / (n + 0.25)
    if n <= 4 * EXACT:
        return float((quantiles(at(np.arange(1.0, n + 1))) ** 2).sum())
    ends = float((quantiles(at(np.arange(1.0, EXACT + 1))) ** 2).sum())
    a, b = (_NORMAL.inv_cdf(at(x)) for x in (EXACT + 0.5, n - EXACT + 0.5))
    inner = (_NORMAL.cdf(b) - b * _density(b)) - (_NORMAL.cdf(a) - a * _density(a))
    return 2 * ends + (n + 0.25) * inner - 2 * (b / _density(b) - a / _density(a)) / (n + 0.25) / 24


def weights(n: int) -> tuple[float, float, float]:
    """(of the largest value, of the second largest, what other order statistics are divided by) for Shapiro and Wilk's W of n >= 3 values."""
    if n == 3:
        return math.sqrt(0.5), 0.0, 1.0
    total, r = squares(n), 1 / math.sqrt(n)
    m1, m2 = (-_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in (1, 2))
    a1 = _poly(_C1, r) + m1 / math.sqrt(total)
    if n <= 5:
        return a1, m2 / math.sqrt((total - 2 * m1**2) / (1 - 2 * a1**2)), math.sqrt((total - 2 * m1**2) / (1 - 2 * a1**2))
    a2 = _poly(_C2, r) + m2 / math.sqrt(total)
    return a1, a2, math.sqrt((total - 2 * m1**2 - 2 * m2**2) / (1 - 2 * a1**2 - 2 * a2**2))


def weight_between(first: int, last: int, n: int, w: tuple[float, float, float]) -> float:
    """Sum of W's weights of ranks first to last."""
    special = {1: -w[0], 2: -w[1], n - 1: w[1], n: w[0]} if n > 3 else {1: -w[0], 2: 0.0, 3: w[0]}
    total = sum(v for i, v in special.items() if first <= i <= last)
    return total + scores_between(max(first, 3), min(last, n - 2), n) / w[2]


def shapiro_p(w: float, n: int) -> float:
    """p of W of n values."""
    if w >= 1:
        return 1.0
    if n == 3:
        return max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(max(w, 0.0))) - math.asin(math.sqrt(0.75)))))
    y = math.log(1 - w)
    if n <= 11:
        gamma = _poly(_G, n)
        if y >= gamma:
            return 0.0
        y, m, s = -math.log(gamma - y), _poly(_C3, n), math.exp(_poly(_C4, n))
    else:
        m, s = _poly(_C5, math.log(n)), math.exp(_poly(_C6, math.log(n)))
    return math.erfc((y - m) / s / math.sqrt(2)) / 2


def shapiro(values: Sequence[float]) -> tuple[float, float]:
    """(W, p) of a few values, 3 at least."""
    x = np.sort(np.asarray(values, float))
    n, x = len(x), x - x.mean()
    w = weights(n)
    a = np.array([weight_between(i, i, n, w) for i in range(1, n + 1)])
    stat = float((a @ x) ** 2 / (x @ x)) if (x @ x) > 0 else 1.0
    return min(stat, 1.0), shapiro_p(min(stat, 1.0), n)


# ---- ranks of counted values ---------------------------------------------------------------------


def before(counted: DataFrame, group: list[str], value: str, n: str = "k") -> DataFrame:
    """counted with `before`: how many (by n) of the group are smaller, and `size`: of all. A value comes once in a group.

    A sort by ranges and two small sums: no group is in one task. The dealt rows are written once, for ranges are drawn anew at each run.
    """
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, _ = materialise(counted.sparkSession, counted.repartitionByRange(parts, *group, value).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = dealt.withColumn("__inside", F.sum(n).over(Window.partitionBy("__part", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)))
    per = dealt.groupBy("__part", *group).agg(F.sum(n).alias("__n"))  # a row a partition and group
    w = Window.partitionBy(*group)
    per = per.select("__part", *group, F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__past"), F.sum("__n").over(w).alias("size"))
    same = [F.col(f"x.{g}").eqNullSafe(F.col(f"y.{g}")) for g in group]
    met = inside.alias("x").join(per.alias("y"), [F.col("x.__part") == F.col("y.__part"), *same])
    return met.select("x.*", (F.coalesce("x.__inside", F.lit(0)) + F.col("y.__past")).alias("before"), "y.size").drop("__part", "__inside")


def _weighed(sizes: pd.Series, firsts: pd.Series, counts: pd.Series) -> pd.Series:
    made = {int(n): weights(int(n)) for n in sizes.unique() if n >= 3}
    return pd.Series([weight_between(int(f) + 1, int(f + k), int(n), made[int(n)]) if n >= 3 else 0.0 for n, f, k in zip(sizes, firsts, counts)], dtype=float)


def _finish(alpha: float):
    """Sums of a group -> the tests."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in f.itertuples(index=False):
            n = int(r.n)
            mean, ss = r.total_d / n, r.ss
            std0, std1 = math.sqrt(ss / n), math.sqrt(ss / (n - 1)) if n > 1 else 0.0
            mean_a = r.total_a / n
            out = {"n": n, "mean_a": mean_a, "mean_b": mean_a + mean, "mean_difference": mean, "gain_pct": 100 * mean / max(1e-6, mean_a), "cohens_d": mean / std1 if std1 > 1e-12 else 0.0}
            w = min(1.0, r.numerator**2 / ss) if n >= 3 and std0 > 1e-12 else None
            p = shapiro_p(w, n) if w is not None else 0.0
            out |= {"shapiro_w": w, "shapiro_p_value": p, "diff_is_normal": w is not None and p > 0.05, "ttest_statistic": 0.0, "ttest_p_value": 1.0, "wilcoxon_statistic": 0.0, "wilcoxon_p_value": 1.0}
            if n >= 2 and std0 > 1e-12:
                t = mean / (std1 / math.sqrt(n))
                out |= {"ttest_statistic": t, "ttest_p_value": E.beta_inc((n - 1) / 2, 0.5, (n - 1) / (n - 1 + t * t))}
            m = int(r.nonzero)
            if n >= 2 and m >= 2:
                low = min(r.plus, m * (m + 1) / 2 - r.plus)
                out |= {"wilcoxon_statistic": low, "wilcoxon_p_value": _signed_p(low, m, r.ties, exact=m <= 50 and m == n and r.ties == 0)}
            out["test"] = "none" if n < 2 else "paired_t" if out["diff_is_normal"] else "wilcoxon"
            out["statistic"], out["p_value"] = (out["ttest_statistic"], out["ttest_p_value"]) if out["diff_is_normal"] else (out["wilcoxon_statistic"], out["wilcoxon_p_value"])
            out["significant"] = bool(n >= 2 and out["p_value"] < alpha)
            rows.append(out)
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _TESTED.split(", ")])

    return run


def _signed_p(low: float, n: int, ties: float, exact: bool) -> float:
    """Two-sided p of the smaller signed rank sum."""
    if exact:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(low - n * (n + 1) / 4) / math.sqrt(var) / math.sqrt(2)) if var > 0 else 1.0


_TESTED = (
    "n long, mean_a double, mean_b double, mean_difference double, gain_pct double, cohens_d double, shapiro_w double, shapiro_p_value double, diff_is_normal boolean, "
    "ttest_statistic double, ttest_p_value double, wilcoxon_statistic double, wilcoxon_p_value double, test string, statistic double, p_value double, significant boolean"
)


def compare(df: DataFrame, group: list[str], a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """Whether b differs from a in each group: rows without both are left out.

    Differences are normal if Shapiro and Wilk's p is over 0.05 (three at least, not all equal); then the paired t-test
    decides, else the signed ranks (exact up to 50 differences without zeros and ties).
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    counted = both.groupBy(*group, F.round(F.col(b) - F.col(a), 12).alias("d")).agg(F.count("*").alias("k"), F.sum(a).alias("total"))
    counted, _ = materialise(df.sparkSession, counted, "counted")  # read three times, and whatever made df would be done as often
    means = counted.groupBy(*group).agg(F.sum("k").alias("n"), F.sum(F.col("d") * F.col("k")).alias("total_d"), F.sum("total").alias("total_a"), F.sum(F.when(F.col("d") != 0, F.col("k")).otherwise(0)).alias("nonzero"))
    same = [F.col(f"x.{g}").eqNullSafe(F.col(f"m.{g}")) for g in group]
    weigh = F.pandas_udf(_weighed, "double")
    ranked = before(counted, group, "d").withColumn("weight", weigh("size", "before", "k")).alias("x")
    mean = F.col("m.total_d") / F.col("m.n")
    spread = ranked.join(means.alias("m"), same).groupBy(*[F.col(f"x.{g}").alias(g) for g in group]).agg(F.sum(F.col("k") * (F.col("d") - mean) * (F.col("d") - mean)).alias("ss"), F.sum(F.col("weight") * (F.col("d") - mean)).alias("numerator"))
    signed = counted.where("d <> 0").groupBy(*group, F.abs("d").alias("size_d")).agg(F.sum("k").alias("k"), F.sum(F.when(F.col("d") > 0, F.col("k")).otherwise(0)).alias("up"))
    k = F.col("k").cast("double")
    ranks = before(signed, group, "size_d").groupBy(*group).agg(F.sum(F.col("up") * (F.col("before") + (k + 1) / 2)).alias("plus"), F.sum(k * k * k - k).alias("ties"))
    facts = means.alias("x").join(spread.alias("m"), same).select("x.*", "ss", "numerator").alias("x").join(ranks.alias("m"), same, "left").select("x.*", F.coalesce("plus", F.lit(0.0)).alias("plus"), F.coalesce("ties", F.lit(0.0)).alias("ties"))
    tests = F.pandas_udf(_finish(alpha), _TESTED)(F.struct("n", "total_d", "total_a", "nonzero", "ss", "numerator", "plus", "ties"))
    return facts.select(*group, tests.alias("t")).select(*group, "t.*")


# ---- all models at once --------------------------------------------------------------------------


def intervals(wide: DataFrame, key: str, values: list[str], draws: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """name, mean, lower, upper, std_err of each column: percentiles of resampled means.

    A row is drawn a Poisson number of times that depends on its key, the seed and the draw only, so all
    columns share their draws however the rows are dealt, and only sums of draws are exchanged.
    """

    def resample(frames):
        total, times = np.zeros((draws, len(values))), np.zeros(draws)
        for f in frames:
            v = f[values].to_numpy(float)
            for some in np.array_split(np.arange(len(f)), -(-len(f) // 512) or 1):
                drawn = np.stack([np.random.default_rng([seed, int(h)]).poisson(1.0, draws) for h in f["__seed"].to_numpy(np.uint64)[some]] or [np.zeros(draws)], axis=1)
                total += drawn @ v[some] if len(some) else 0
                times += drawn.sum(1) if len(some) else 0
        yield pd.DataFrame({"draw": np.repeat(np.arange(draws), len(values)), "name": values * draws, "total": total.ravel(), "n": np.repeat(times, len(values))})

    rows = wide.select(F.xxhash64(key).alias("__seed"), *values).dropna()
    drawn = rows.mapInPandas(resample, "draw int, name string, total double, n double").groupBy("name", "draw").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    ends = drawn.groupBy("name").agg(F.percentile("m", (1 - level) / 2).alias("lower"), F.percentile("m", (1 + level) / 2).alias("upper"), F.stddev_pop("m").alias("std_err"))
    means = rows.agg(*[F.avg(v).alias(v) for v in values]).select(F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).alias("mean")) for v in values])).alias("x")).select("x.*")
    return means.join(ends, "name").select("name", "mean", "lower", "upper", "std_err")


#: What is tested, and which models are set against each other.
METRICS = ("ndcg_at_5", "precision_at_1_strict", "precision_at_5_strict", "mrr_strict", "map_at_5_strict")
PAIRS = (("M0", "M1"), ("M0", "M2"), ("M1", "M2"), ("M2", "M3"), ("M3", "M4"), ("M4", "M5"), ("M0", "M5"))


def tops(scored: DataFrame, models: Mapping[str, str], k: int = 5) -> DataFrame:
    """model, query, item, score, rank of the first k items of a query by each model's expression, equal scores by item; other columns stay.

    scored: query, item and what the expressions need. Rows are dealt by query once and ordered for each
    model within the query's list; only the first k are repeated a model.
    """
    kept = [c for c in scored.columns if c not in ("query", "score", "rank", "model")]
    rows = scored.select("query", *kept, *[F.round(F.expr(x), 9).alias(f"__{m}") for m, x in models.items()])
    lists = rows.groupBy("query").agg(F.collect_list(F.struct(*kept, *[f"__{m}" for m in models])).alias("all"))

    def first(m: str) -> Column:
        # as a falling order of rows: no number first, what is null last
        keyed = F.transform("all", lambda x: F.struct(x[f"__{m}"].isNull().alias("none"), (~F.isnan(x[f"__{m}"])).alias("some"), (-x[f"__{m}"]).alias("down"), x["item"].alias("by"), x.alias("x")))
        return F.transform(F.slice(F.sort_array(keyed), 1, k), lambda y, i: F.struct(F.lit(m).alias("model"), *[y["x"][c].alias(c) for c in kept], y["x"][f"__{m}"].alias("score"), (i + 1).alias("rank")))

    return lists.select("query", F.explode(F.flatten(F.array(*[first(m) for m in models]))).alias("__x")).select("query", "__x.*")


def battery(rel: DataFrame, k: int = 5) -> DataFrame:
    """model, query and the metrics of METRICS, to six digits, of rows (model, query, rank, rel); strict ones count rel = 2."""
    w = Window.partitionBy("model", "query")
    hit = (F.col("rel") >= 2).cast("int")
    top = rel.where(F.col("rank") <= k).withColumns({"hit": hit, "ideal": F.row_number().over(w.orderBy(F.desc("rel"), "rank")), "hits": F.sum(hit).over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))})
    gain, some = F.pow(F.lit(2.0), F.col("rel")) - 1.0, F.col("hit") == 1
    dcg, idcg = F.sum(gain / F.log2(F.col("rank") + 1.0)), F.sum(gain / F.log2(F.col("ideal") + 1.0))
    return top.groupBy("model", "query").agg(
        F.round(F.when(idcg == 0, 0.0).otherwise(dcg / idcg), 6).alias("ndcg_at_5"), F.max(F.when(F.col("rank") == 1, F.col("hit")).otherwise(0)).cast("double").alias("precision_at_1_strict"),
        F.round(F.avg("hit"), 6).alias("precision_at_5_strict"), F.round(F.coalesce(1.0 / F.min(F.when(some, F.col("rank"))), F.lit(0.0)), 6).alias("mrr_strict"),
        F.round(F.coalesce(F.sum(F.when(some, F.col("hits") / F.col("rank"))) / F.sum("hit"), F.lit(0.0)), 6).alias("map_at_5_strict"),
    )


def aligned(rel: DataFrame, truth: DataFrame, models: Sequence[str]) -> DataFrame:
    """Metrics of the queries that every model answers and the truth knows, side by side: query, <model>_<metric>."""
    cells = [F.max(F.when(F.col("model") == m, F.col(x))).alias(f"{m}_{x}") for m in models for x in METRICS]
    wide = battery(rel).groupBy("query").agg(F.count_distinct("model").alias("__n"), *cells).where(F.col("__n") == len(models)).drop("__n")
    return wide.join(truth.select("query").distinct(), "query", "left_semi")


def benchmark(wide: DataFrame, pairs: Sequence[tuple[str, str]] = PAIRS, alpha: float = 0.05) -> DataFrame:
    """model_a, model_b, metric and the paired test of every pair of models and metric, from `aligned` metrics."""
    rows = [F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.lit(m).alias("metric"), F.col(f"{a}_{m}").alias("a"), F.col(f"{b}_{m}").alias("b")) for a, b in pairs for m in METRICS]
    return compare(wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*"), ["model_a", "model_b", "metric"], "a", "b", alpha)
