"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerwise.catalogue import ORACLE, QUERIES
from ledgerwise.plans import fixtures

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (str, bool)):
        return str(v)
    return f"{float(v) + 0.0:.6g}" if hasattr(v, "__float__") else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"sampled_edges"}))
def test_models_judge_each_provider_once(spark, name):
    """Their values are tested in test_models.py."""
    out, column = QUERIES[name](spark, SF), {"iso_forest_rank": "isolation_rank", "gbt_score": "boosted", "drivers": "score", "shapley_values": "margin"}.get(name, "error")
    ids, values = zip(*((r["npi"], r[column]) for r in out.collect()), strict=True)
    everyone = {r["npi"] for r in fixtures.providers(spark, SF).select("npi").collect()}
    assert len(ids) == len(everyone) and set(ids) == everyone
    assert all(v is not None and v == v for v in values) and len(set(values)) > 3


def test_sampled_edges_leave_each_provider_with_partners(spark):
    out = QUERIES["sampled_edges"](spark, SF)
    assert out.count() >= 100 and out.select("source", "target").distinct().count() == out.count()


def test_entry(spark):
    assert entry.entry(spark).columns == ["npi", "specialty", "state", "peer_median_payment", "payment_vs_peer"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
