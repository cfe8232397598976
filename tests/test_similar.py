"""The label join against all pairs."""

import random

import pytest

from matchloom.operators import similar
from matchloom.plans import catalog
from tests.oracle import SF


def labels(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghilmnoprstuyé") for _ in range(r.randint(2, 9))) for _ in range(120)]
    return sorted({" ".join(r.choice(words) for _ in range(r.randint(1, 5))) for _ in range(n)})


def slow(a, b):
    """The longest common subsequence by its table."""
    row = [0] * (len(b) + 1)
    for c in a:
        last = 0
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def all_pairs(asked, others, least, most):
    out = set()
    for a in asked:
        found = sorted((-q, b) for b in others if (q := similar.ratio(a, b)) >= least)[:most]
        out |= {(a, b, -q, k) for k, (q, b) in enumerate(found, 1)}
    return out


def test_subsequence_and_ratio():
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd ") for _ in range(r.randint(0, 90))) for _ in range(2))
        assert similar.subsequence(a, b) == slow(a, b)
    assert similar.ratio("law", "school of law") == 100 and similar.ratio("", "law") == 0 and similar.ratio("b a", "a b") == 100
    assert similar.ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a hare") == pytest.approx(200 * 20 / 44)


@pytest.mark.parametrize("shard", [300, 4096])
def test_join_equals_all_pairs(spark, shard, monkeypatch):
    monkeypatch.setattr(similar, "SHARD", shard)
    monkeypatch.setattr(similar, "ASKED", 40)
    others = labels(2_000) + ["  ", "a " * 50 + "zz", "long " + "x" * 130]
    asked = [*labels(2_000)[::25], "long xx", "", "nothing like it 0123456789"]
    df = lambda x: spark.createDataFrame([(v, 1) for v in [*x, None]], "label string, rank int").repartition(5)
    got = similar.alike(df(asked * 2), df(others))
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {tuple(r) for r in got.collect()} == all_pairs(asked, [x for x in others if x.strip()], 55.0, 30)
    assert similar.alike(df([]), df(others)).count() == 0 and similar.alike(df(asked), df([])).count() == 0


def test_staff_of_a_module(spark):
    modules = spark.createDataFrame([(1, "computer science"), (1, "school of law"), (2, "zoology")], "module_id long, label string")
    staff = spark.createDataFrame([(i, f"n{9 - i}", d) for i, d in enumerate(["department of computer science", "law", "law", "history", "", None, "computing science", "zoölogy"])], "staff_id long, full_name string, department string")
    got = sorted((r["module_id"], r["rank"], r["staff_id"], r["department"]) for r in similar.alike_staff(modules, staff).collect())
    assert got == [(1, 1, 0, "department of computer science"), (1, 2, 2, "law"), (1, 3, 1, "law"), (1, 4, 6, "computing science"), (2, 1, 7, "zoölogy")]


def test_query_equals_all_pairs(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    asked = {f"{r['p_name']} {r['p_type'].lower()}" for r in parts}
    others = {f"the {r['p_name']} {r['p_brand'].lower()} unit" for r in parts}
    assert {tuple(r) for r in catalog.queries()["j9_alike_labels"](spark, SF).collect()} == all_pairs(asked, others, 55.0, 30)


def test_modules_of_the_same_labels_are_ranked_once(spark):
    r = random.Random(9)
    departments = [f"department of {w}" for w in ("law", "lawn", "laws", "claw", "flaws")]
    people = [(i, f"n{r.randint(0, 9)}", r.choice(departments)) for i in range(40)]
    modules = [(m, x) for m in range(30) for x in (("school of law", "claws"), ("school of flaws",))[m % 2] for _ in range(2)]
    got = similar.alike_staff(spark.createDataFrame(modules, "module_id long, label string"), spark.createDataFrame(people, "staff_id long, full_name string, department string"), 40.0, 12)
    assert "windowspecdefinition(module_id" not in got._jdf.queryExecution().toString()
    want = set()
    for m in range(30):
        mine = {x for k, x in modules if k == m}
        each = sorted((-max(similar.ratio(x, d) for x in mine), d, n, i) for i, n, d in people if max(similar.ratio(x, d) for x in mine) >= 40)
        want |= {(m, i, d, -s, k + 1) for k, (s, d, n, i) in enumerate(each[:12])}
    assert {tuple(x) for x in got.collect()} == want
