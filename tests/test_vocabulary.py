"""Vocabularies with and without a bound."""

import os

import duckdb

from matchloom.operators import lexical as L
from matchloom.plans import catalog
from matchloom.tables import TABLES
from tests.oracle import SF, same


def test_fields_have_no_bound_on_their_terms(spark, tmp_path):
    """40,000 names are more than 75,000 terms and pairs of terms."""
    for t in TABLES:
        if t != "customer":
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    duckdb.sql(f"""COPY (SELECT i AS c_custkey, 'Customer#' || lpad(CAST(i AS VARCHAR), 9, '0') AS c_name, CAST(i % 25 AS INT) AS c_nationkey, 1.0 AS c_acctbal,
        CASE WHEN i % 2 = 0 THEN 'FURNITURE' ELSE 'BUILDING' END AS c_mktsegment FROM range(40000) t(i)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)""")
    same(spark, catalog.queries()["t5_field_weighted"], catalog.oracles()["t5_field_weighted"], str(tmp_path))


def test_fit_without_a_bound(spark):
    docs = spark.createDataFrame([(1, "a", "red green"), (2, "a", "red blue"), (3, "b", "red")], "id long, field string, text string")
    found = L.terms(docs, ["id", "field"], "text")
    count = lambda **kw: L.fit(found, docs, ["field"], max_df=1.0, **kw).count()
    assert count(features=1) == 2 and count(features=None) == count() == 6


def test_counts_equal_those_of_terms_and_exchange_no_texts(spark):
    docs = spark.createDataFrame([(1, "Red green red green"), (2, "red  RÉD"), (3, None), (4, "x"), (5, "blue")], "id long, text string")
    made = L.counts(docs, "text")
    plain = L.terms(docs, ["id"], "text").groupBy("term").agg(L.F.count("*").alias("df"), L.F.sum("tf").alias("total"))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, plain.collect())) and made.where("term = 'red' and df = 2 and total = 4").count() == 1
    plan = L.fit_counts(made, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan
    words = spark.createDataFrame([("red",), ("red green",)], "term string")
    assert sorted(map(tuple, L.terms(docs, ["id"], "text", within=words).collect())) == [(1, "red", 2), (1, "red green", 2), (2, "red", 2)]
