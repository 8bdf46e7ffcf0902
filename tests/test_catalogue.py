"""Every audit query with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from auditspark import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(df):
    return sorted(tuple(round(x, 4) if isinstance(x, float) else str(x)[:19] for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    assert plain(catalogue.QUERIES[name](spark, SF).toPandas()) == plain(con.sql(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize(
    "name,operator,sides",
    [
        ("expense_without_travel_request", "without_travel_request", [1]),
        ("office_swipe_on_offsite_claim", "office_swipe", [1]),
        ("attendance_city_mismatch", "swipe_city_mismatch", [1]),
        ("days_without_swipe", "days_without_swipe", [0, 1]),
        ("travel_verification_mismatch", "travel_verification", [1]),
        ("travel_verification_not_found", "travel_verification", [1]),
    ],
)
def test_side_tables_are_whole(spark, monkeypatch, name, operator, sides):
    seen = []
    monkeypatch.setattr(catalogue.external, operator, lambda *a, f=getattr(catalogue.external, operator): seen.append([a[k].count() for k in sides]) or f(*a))
    catalogue.QUERIES[name](spark, SF)
    assert seen == [[catalogue.ledger(spark, SF).count()] * len(sides)]


def test_company_graph_grows_with_customers(spark):
    sizes = []
    for sf in (SF, SF.replace("0.001", "0.01")):
        edges, pairs = catalogue.company_graph(spark, sf)
        nodes = edges.select("from").union(edges.select("to")).distinct().count()
        sizes.append((edges.count(), nodes, pairs.count()))
    (a, m, p), (b, n, q) = sizes
    assert n / m == pytest.approx(b / a, rel=0.2) and q / p == pytest.approx(b / a, rel=0.2)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
