"""Topic candidates against the rules, one record at a time."""

import hashlib
import json

import pytest

from matchloom.operators import topic_records as TR


def test_rules():
    assert TR.cleaned("  C++ & C#/.NET — Déjà_vu (naïve)! ") == "cpp and csharp dotnet deja vu naive" and TR.cleaned("c ++") == "cpp" and TR.cleaned("—") == ""
    stop, generic = frozenset(TR.STOP), frozenset(TR.GENERIC)
    assert TR.normalised("the networks of 2020 using graphs", {"networks": "network", "graphs": "the"}, stop) == "network"
    ok = lambda t: TR.valid(t, generic, stop, 1, 8)
    assert ok("ai") and not ok("a") and not ok("12") and not ok("research") and not ok("of the") and not ok(" ".join("abcdefghi")) and not ok("") and ok("advanced topics in law")


def test_records(spark):
    ddl = "module_id string, staff_id string, title string, topics array<struct<label:string,score:string>>, keywords array<string>, topic_keywords string, note string"
    rows = [
        (None, "s1", "t", [("Graph Theory", "2.5"), ("Graph Theory", "much"), (None, "1"), ("research", None)], ["Neural  Networks", " ", None, "the"], "C++", "x"),
        ("", "", "only title", None, None, None, None), (None, None, None, None, ["law"], "", 'q"é'), ("m1", "s2", None, [], [], "   ", None),
    ]
    df = spark.createDataFrame(rows, ddl)
    got = [tuple(r) for r in TR.candidates(df, "staff", {"networks": "network"}).collect()]
    digest = hashlib.md5(json.dumps({"keywords": ["law"], "note": 'q"é', "topic_keywords": ""}, sort_keys=True).encode()).hexdigest()
    assert sorted(got) == sorted([
        ("s1", "staff", "topics", 0, "Graph Theory", "graph theory", "graph theory", 2.5), ("s1", "staff", "topics", 0, "Graph Theory", "graph theory", "graph theory", 1.0),
        ("s1", "staff", "topic_keywords", 1, "C++", "cpp", "cpp", 1.0), ("s1", "staff", "keywords", 2, "Neural  Networks", "neural networks", "neural network", 1.0), (digest, "staff", "keywords", 2, "law", "law", "law", 1.0),
    ])
    assert TR.candidates(df.select("title"), "staff").count() == 0 and TR.candidates(df.limit(0), "staff").count() == 0
    with pytest.raises(ValueError):
        TR.candidates(spark.createDataFrame([(1,)], "keywords int"), "staff")


def test_lemmas_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame([("Runs", "run"), ("runs", "runn"), ("law", "law")], "word string, lemma string")
    assert TR.lemma_table(df) == {"runs": "run"}
    monkeypatch.setattr(TR, "MOST_LEMMAS", 0)
    with pytest.raises(ValueError):
        TR.lemma_table(df)


def test_values_carry_only_their_records_id_and_are_cleaned_once(spark):
    df = spark.createDataFrame([(1, ["law", "art"])], "id long, keywords array<string>")
    plan = TR.candidates(df, "staff")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[made(") == 1
    taken_apart = next(line for line in plan.splitlines() if "Generate explode(" in line)
    assert "record_id" in taken_apart and "keywords" not in taken_apart
