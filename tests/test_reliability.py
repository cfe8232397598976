"""Shapiro and Wilk's W against published values, the distributed tests against small arrays, shared draws."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import evaluation as E
from matchloom.operators import reliability as R
from tests.oracle import SF

#: Well-known data sets with (W, p) as R prints them.
STOPPING = [2, 10, 4, 22, 16, 10, 18, 26, 34, 17, 28, 14, 20, 24, 28, 26, 34, 34, 46, 26, 36, 60, 80, 20, 26, 54, 32, 40, 32, 40, 50, 42, 56, 76, 84, 36, 46, 68, 32, 48, 52, 56, 64, 66, 54, 70, 92, 93, 120, 85]
SPEED = [4, 4, 7, 7, 8, 9, 10, 10, 10, 11, 11, 12, 12, 12, 12, 13, 13, 13, 13, 14, 14, 14, 14, 15, 15, 15, 16, 16, 17, 17, 17, 18, 18, 18, 18, 19, 19, 19, 20, 20, 20, 20, 20, 22, 23, 24, 24, 24, 24, 25]
MILES = [21, 21, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4, 14.7, 32.4, 30.4, 33.9, 21.5, 15.5, 15.2, 13.3, 19.2, 27.3, 26, 30.4, 15.8, 19.7, 15, 21.4]
MEN = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]  # the example of the paper of 1965
PUBLISHED = [(MEN, 0.78881, 0.006704), ([1, 2, 3, 4, 5], 0.98676, 0.9672), (STOPPING, 0.95144, 0.0391), (SPEED, 0.97765, 0.4576), (MILES, 0.94756, 0.1229)]


def test_published_values():
    for values, want, p_want in PUBLISHED:
        w, p = R.shapiro(values)
        assert abs(w - want) < 1e-5 and abs(p - p_want) < 1e-4
    assert R.shapiro([1, 2, 4])[0] == pytest.approx(27 / 28, abs=1e-9) and R.shapiro([1, 2, 4])[1] == pytest.approx(0.6368868, abs=1e-6)


def test_weights_are_a_unit_vector_and_sums_are_exact():
    for n in (3, 4, 5, 6, 7, 11, 12, 50, 500):
        a = np.array([R.weight_between(i, i, n, R.weights(n)) for i in range(1, n + 1)])
        assert abs(a @ a - 1) < 1e-9 and abs(a.sum()) < 1e-9 and abs(R.weight_between(1, n, n, R.weights(n))) < 1e-9
    n = 30_000
    each = R.quantiles((np.arange(1.0, n + 1) - 0.375) / (n + 0.25))
    assert abs(R.squares(n) - (each**2).sum()) < 1e-7 and abs(R.scores_between(5, 21_000, n) - each[4:21_000].sum()) < 1e-7
    assert abs(R.squares(10**12) / 10**12 - 1) < 1e-6


def test_before_counts_what_is_smaller(spark):
    r = random.Random(3)
    rows = list({(g, r.randint(0, 400)): (g, 0, 0) for g in ["a", "b", None] for _ in range(200)})
    rows = [(g, float(v), r.randint(1, 5)) for g, v in rows]
    df = spark.createDataFrame(rows, "g string, d double, k long").repartition(5)
    for x in R.before(df, ["g"], "d").collect():
        assert (x["before"], x["size"]) == (sum(k for g, v, k in rows if g == x["g"] and v < x["d"]), sum(k for g, v, k in rows if g == x["g"]))


def test_before_on_more_rows_than_ranges_are_drawn_from(spark):
    df = spark.range(60_000).selectExpr("(id * 7919) % 60000 as v", "id % 3 as g", "1L as k").repartition(13)
    got = R.before(df, ["g"], "v")
    per = got.groupBy("g").agg(F.max("before").alias("most"), F.count_distinct("before").alias("n"), F.min("size").alias("size")).collect()
    assert {(r["g"], r["most"], r["n"], r["size"]) for r in per} == {(i, 19_999, 20_000, 20_000) for i in range(3)}
    whole = R.before(df.drop("g"), [], "v")
    assert whole.count() == 60_000 and whole.where("before <> v or size <> 60000").isEmpty()


def plain(d, mean_a):
    """The tests on an array."""
    n, m = len(d), int((d != 0).sum())
    out = {"ttest_p_value": 1.0, "wilcoxon_p_value": 1.0, "shapiro_p_value": 0.0}
    if n >= 3 and np.std(d) > 1e-12:
        out["shapiro_p_value"] = R.shapiro(d)[1]
    if n >= 2 and np.std(d) > 1e-12:
        out["ttest_p_value"] = E.t_test(d)[1]
    if m >= 2:
        v = d[d != 0]
        ranks = np.array([(np.abs(v) < abs(x)).sum() + ((np.abs(v) == abs(x)).sum() + 1) / 2 for x in v])
        plus = ranks[v > 0].sum()
        low, ties = min(plus, m * (m + 1) / 2 - plus), sum(c**3 - c for c in np.unique(np.abs(v), return_counts=True)[1])
        if m == n and m <= 50 and ties == 0:
            signs = [sum(r for r, s in zip(ranks, bin(x)[2:].zfill(m)) if s == "1") for x in range(2**m)]
            out["wilcoxon_p_value"] = min(1.0, 2 * sum(s <= low for s in signs) / 2**m)
        else:
            z = (low - m * (m + 1) / 4) / math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48)
            out["wilcoxon_p_value"] = math.erfc(abs(z) / math.sqrt(2))
    return out


def test_compare_equals_arrays(spark):
    r = random.Random(6)
    groups = {"normal": [r.gauss(0.1, 1) for _ in range(60)], "few": [0.5, 1.25, -0.25, 2.0, 3.5, -0.75, 1.5], "ties": [r.choice([0.0, 0.0, 0.1, 0.2, -0.1]) for _ in range(300)],
              "equal": [0.5] * 9, "none": [0.0] * 5, "one": [0.3], "two": [0.3, 0.1], "three": [0.1, 0.2, 0.9]}
    rows = [(g, 1.0, 1.0 + d) for g, v in groups.items() for d in v] + [("few", None, 1.0), ("few", 1.0, None)]
    got = {x["g"]: x for x in R.compare(spark.createDataFrame(rows, "g string, a double, b double").repartition(6), ["g"], "a", "b").collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        d = np.round(np.array([1.0 + x for x in v]) - 1.0, 12)
        for c, want in plain(d, 1.0).items():
            assert got[g][c] == pytest.approx(want, abs=1e-9), (g, c)
        assert got[g]["test"] == ("none" if len(v) < 2 else "paired_t" if got[g]["shapiro_p_value"] > 0.05 else "wilcoxon")
        assert got[g]["mean_difference"] == pytest.approx(d.mean()) and got[g]["n"] == len(v)
    assert got["normal"]["test"] == "paired_t" and got["ties"]["test"] == "wilcoxon" and not got["one"]["significant"]


def test_draws_are_shared_and_independent_of_partitions(spark):
    r = random.Random(2)
    rows = [(i, v := r.random(), v + 0.25, 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "q long, a double, b double, one double")
    got = {x["name"]: x for x in R.intervals(df.repartition(3), "q", ["a", "b", "one"], draws=300).collect()}
    again = {x["name"]: x for x in R.intervals(df.repartition(7), "q", ["a", "b", "one"], draws=300).collect()}
    for c in ("lower", "upper", "std_err", "mean"):
        assert got["a"][c] == pytest.approx(again["a"][c], abs=1e-9)
    assert got["b"]["lower"] - got["a"]["lower"] == pytest.approx(0.25) and got["one"]["std_err"] < 1e-12
    _, low, high = E.bootstrap(np.array([x[1] for x in rows]), 2000)
    assert abs(got["a"]["lower"] - low) < 0.02 and abs(got["a"]["upper"] - high) < 0.02


def test_benchmark_has_all_pairs_and_metrics(spark):
    from matchloom.plans import catalog

    rows = catalog.queries()["v6_v7_paired_tests"](spark, SF).collect()
    assert {(x["model_a"], x["model_b"], x["metric"]) for x in rows} == {(a, b, m) for a, b in R.PAIRS for m in R.METRICS} and len(rows) == 35
    ends = catalog.queries()["v5_bootstrap"](spark, SF).collect()
    assert len(ends) == 30 and all(x["lower"] <= x["mean"] <= x["upper"] for x in ends)


def test_tops_equal_a_ranking_of_each_model(spark):
    r = random.Random(6)
    rows = [(q, i, r.randint(0, 3) / 3, r.randint(0, 3) / 3) for q in range(20) for i in range(r.randint(1, 9))] + [(0, 20, None, 0.1)]
    models = {"A": "score", "B": "core", "C": "0.5 * core + 0.5 * score"}
    scored = spark.createDataFrame(rows, "query long, item long, score double, core double")
    got = {(x["model"], x["query"], x["rank"], x["item"], x["score"]) for x in R.tops(scored, models, 3).collect()}
    rows.pop()
    want = set()
    for m, of in (("A", lambda x: x[2]), ("B", lambda x: x[3]), ("C", lambda x: 0.5 * x[3] + 0.5 * x[2])):
        for q in range(20):
            first = sorted((-round(of(x), 9), x[1]) for x in rows + [(0, 20, -9.0, 0.1 if m == "B" else -9.0)] if x[0] == q)[:3]
            want |= {(m, q, k + 1, i, None if s == 9.0 else -s) for k, (s, i) in enumerate(first)}
    assert got == want


def test_what_is_compared_is_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    df = spark.range(40).select(F.lit("g").alias("g"), (F.col("id") / 7).alias("a"), (F.col("id") % 5 / 3).alias("b"))
    R.compare(df.mapInPandas(told, "g string, a double, b double"), ["g"], "a", "b").collect()
    assert seen.value == 40
