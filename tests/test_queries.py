"""Every registered query against its DuckDB oracle on the smallest scale,
plus the smoke contract of the entry point."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from sigeval.plans.queries import QUERIES
from sigeval.session import TABLES

sys_path_ok = True


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    vals = [tuple(_norm(x) if x == x else None for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(vals, key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry(spark):
    rows = {r.label: r.n_sequences for r in E.entry(spark).collect()}
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").groupBy("user_id").count().collect()
    assert sum(rows.values()) == sum(-(-r["count"] // 25) for r in events)


def test_every_query_has_oracle_or_is_rows_only():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    sdf = E.queries()[key](spark, SF_SMALL).toPandas()
    sql = E.oracle_sql().get(key)
    if sql is None:
        assert len(sdf) > 0
        return
    odf = con.execute(sql).df()
    assert _rows(sdf) == _rows(odf)


def test_every_event_is_in_a_sequence(spark):
    seqs = E.queries()["encode_sequences"](spark, SF_SMALL)
    held = seqs.selectExpr("sum(length(sequence)) AS n").first().n
    assert held == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
