import numpy as np
import pytest

from matchloom.operators import aspects
from matchloom.operators import collaboration as C
from matchloom.operators.semantic import HashingEncoder


def test_affinities_are_cosines(spark):
    vectors = aspects.encoded(HashingEncoder())
    assert len(vectors) == 11 and all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in vectors.values())
    texts = ["network security encryption privacy", "macroeconomics and fiscal policy of banking", "nothing at all of it"]
    own = HashingEncoder().encode(texts)
    rows = [(i, v.tolist(), own[1].tolist() if i else None) for i, v in enumerate(own)] + [(7, None, own[0].tolist()), (8, [1.0, 2.0], None), (9, [None] * len(own[0]), None)]
    df = spark.createDataFrame(rows, "module_id long, vector array<double>, lead_vector array<double>").repartition(3)
    got = {(r["module_id"], r["aspect"]): (r["affinity"], r["lead"]) for r in aspects.affinities(df, vectors).collect()}
    assert len(got) == 6 * 11
    for i in range(3):
        for a, v in vectors.items():
            assert got[i, a][0] == pytest.approx(float(own[i] @ v), abs=1e-6) and got[i, a][1] == pytest.approx(float(own[1] @ v) if i else 0.0, abs=1e-6)
    assert all(got[i, a][0] == 0 for i in (7, 8, 9) for a in vectors) and got[7, "ethics_governance_law"][1] == pytest.approx(float(own[0] @ vectors["ethics_governance_law"]), abs=1e-6)
    best = max(vectors, key=lambda a: got[0, a][0])
    assert best == "cybersecurity_trust_cryptography"
    needs = C.gaps(spark.createDataFrame([(1, "a", 0.19, 0.0), (1, "b", 0.17, 0.0), (2, "a", 0.5, 0.1), (2, "b", 0.19, 0.0), (2, "c", 0.6, 0.6)], "module_id long, aspect string, affinity double, lead double"))
    assert {(r["module_id"], r["aspect"]): r["need"] for r in needs.collect()} == {(1, "a"): "Moderate Co-Delivery Need", (2, "a"): "High Co-Delivery Need", (2, "c"): "Covered By Primary Lead"}


def test_a_catalogue_is_bounded(spark, monkeypatch):
    df = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "aspect string, vector array<double>")
    assert list(aspects.catalogue(df)) == ["a", "b"]
    monkeypatch.setattr(aspects, "MOST", 1)
    with pytest.raises(ValueError):
        aspects.catalogue(df)
