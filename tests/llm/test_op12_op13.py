"""Fill-in-middle and whitening: against SQL, an exact round trip, plain Python and numpy's eigenvectors."""

import hashlib
import math
import re

import numpy as np
import pytest

from matchloom.llm import op12_fim as fim
from matchloom.llm import op13_whitening as white
from matchloom.llm import registry
from matchloom.llm.common import ready
from tests.oracle import SF, same

TEXTS = [None, "", " ", "one", " two  words\n", "a <P> b c", "<S>", "x<M>", "ends with <", "<P", "ünïcode \U0001d54f wörds  　 wide space", "word " * 40_000 + "\n\n", "x" * 300_000, "\ta b c d e f g h i j"]
COLUMNS = "doc_id long, text string, n long, output string, form string, middle_chars long"


def plain(doc_id, text, seed=42):
    """The contract's own words."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_op12_equals_sql(spark):
    same(spark, registry.QUERIES["op12_fim"], registry.ORACLES["op12_fim"])


def test_op12_forms_and_round_trip(spark):
    rows = [(i, t, 1, "o", "f", 2) for k in range(12) for i, t in [(k * len(TEXTS) + j, t) for j, t in enumerate(TEXTS)]]
    docs = ready(spark).createDataFrame([*rows, rows[4]], COLUMNS).repartition(3)
    made = fim.fill_in_middle(docs)
    back = {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["text"]) for r in made.withColumn("text", fim.restored(made)).collect()}
    assert made.count() == len(rows) + 1 and {x[1] for x in back.values()} == {"plain", "psm", "spm"}
    for i, t, *_ in rows:
        assert back[i] == (*plain(i, t), t or "")
    got = {r["doc_id"]: r for r in fim.digests(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, t, *_ in rows:
        assert (got[i]["output_sha256"], got[i]["restored_sha256"]) == (sha(plain(i, t)[4]), sha(t or ""))


def test_op12_null_ids_other_rates_and_no_rows(spark):
    docs = ready(spark).createDataFrame([(None, "some words here"), (None, "some words here"), (3, "a b")], "doc_id long, text string")
    got = fim.digests(docs, rates=fim.Rates(100, 0)).collect()
    assert {r["form"] for r in got} == {"psm"} and len({r["output_sha256"] for r in got if r["doc_id"] is None}) == 1
    assert fim.digests(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs.selectExpr("doc_id", "text", "1L as n"), keep=("doc_id", "n"))


def vectors(spark, rows, parts=5):
    return ready(spark).createDataFrame([(i, v, "x", 0.5) for i, v in rows], "vec_id long, embedding array<double>, label string, whitened double").repartition(parts)


def check(got, rows, k=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(0)
    centred = np.array([[float(n * a - b) / n for a, b in zip(r, s)] for r in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    want = centred @ v[:, :k]
    found = {(r["vec_id"], r["component"]): r for r in got}
    assert len(found) == n * min(k, x.shape[1])
    for c in range(min(k, x.shape[1])):
        mine = np.array([found[i, c + 1]["whitened"] for i, _ in rows])
        if e[c] < 1e-9 * e[0]:
            continue
        theirs = want[:, c] / np.sqrt(e[c])
        assert np.allclose(mine, theirs * np.sign(mine @ theirs), atol=1e-6)
        assert found[rows[0][0], c + 1]["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-9)
    for (i, _), r in zip(rows, x):
        assert found[i, 1]["deviation"] == sum((n * a - b) ** 2 for a, b in zip(r, s)) and found[i, 1]["n"] == n and found[i, 1]["identity_error"] < 1e-9


def test_op13_equals_numpy_on_the_table(spark):
    df = ready(spark).read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    check(registry.QUERIES["op13_whitening"](spark, SF).collect(), rows)


def test_op13_falling_variances(spark):
    r = np.random.default_rng(3)
    turn = np.linalg.qr(r.normal(size=(12, 12)))[0]
    rows = list(enumerate((r.normal(size=(600, 12)) * 3.0 ** -np.arange(12) * 400 @ turn).tolist()))
    check(white.whiten(vectors(spark, rows, 40)).collect(), rows)  # more tasks than one level of the tree takes


def test_op13_edge_rows(spark):
    good = [(i, [float(i % 3), float(i % 2), 0.25]) for i in range(12)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan"), 1.0, 1.0]), (94, [1.0, float("-inf"), 1.0]), (95, [1.0, 2.0]), (96, [1e300, 0.0, 0.0])]
    got = white.whiten(vectors(spark, good + bad)).collect()
    assert {r["vec_id"] for r in got} == set(range(12)) and {r["component"] for r in got} == {1, 2, 3}
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got)
    check(got, good)
    one = white.whiten(vectors(spark, [(1, [3.0, 4.0])])).collect()
    assert len(one) == 2 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in one)
    assert white.whiten(vectors(spark, [])).count() == 0 and white.whiten(vectors(spark, bad[:3])).count() == 0
    twice = white.whiten(vectors(spark, good + [good[3], (None, good[4][1])])).collect()
    assert len(twice) == 14 * 3 and {r["n"] for r in twice} == {14}


def test_op13_large_numbers_stay_exact(spark):
    rows = [(i, [1e6 * i, -1e6 * i * i]) for i in range(9)]
    got = {r["vec_id"]: r for r in white.whiten(vectors(spark, rows)).collect() if r["component"] == 1}
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = [sum((9 * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    assert [got[i]["deviation"] for i in range(9)] == [w if w < 1 << 63 else None for w in want]


def test_jacobi_is_accurate_in_small_singular_values():
    r = np.random.default_rng(1)
    a = np.linalg.qr(r.normal(size=(9, 9)))[0] * 10.0 ** -np.arange(9)  # graded columns
    sigma, v = white.jacobi(np.linalg.qr(a, mode="r"))
    assert np.allclose(sigma, 10.0 ** -np.arange(9), rtol=1e-12) and np.allclose(v.T @ v, np.eye(9), atol=1e-13)
