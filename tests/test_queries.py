import pytest

from matchloom.plans import catalog
from tests.oracle import SF, same

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_shared_terms_are_made_of_the_best_pairs_alone(spark, monkeypatch):
    from matchloom.operators import lexical as L
    from matchloom.plans import catalog

    seen, shared = [], L.shared_terms
    monkeypatch.setattr(L, "shared_terms", lambda found, best, *a: seen.append((found.select("item_id", "doc_id").distinct().count(), best.count())) or shared(found, best, *a))
    assert catalog.queries()["t4_shared_terms"](spark, "/root/testdata/sf0.001").count()
    assert seen[0][0] == seen[0][1]
