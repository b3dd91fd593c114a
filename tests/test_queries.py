"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Queries that SQL cannot express, by operator tests.
NO_SQL = {n for n in entry.queries() if n.startswith(("op2_", "op3_", "op4_", "op6_", "op8_", "op9_", "op10_", "op13_")) or n == "pipeline"}


def _cell(v):
    """Numbers to 6 decimals, whatever their type; null and NaN alike."""
    if v is None or v != v:
        return ""
    if isinstance(v, str):
        return v
    return str(round(float(v), 6) + 0.0)


def _rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    pdf = pdf.where(pdf.notna(), None)
    return sorted(tuple(map(_cell, r)) for r in pdf.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF).exists():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    mine = entry.queries()[name](spark, SF).toPandas()
    theirs = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert _rows(mine) == _rows(theirs)


def test_queries_without_sql_give_rows(spark):
    assert set(entry.queries()) - set(entry.oracle_sql()) == NO_SQL
    for name in sorted(NO_SQL):
        assert entry.queries()[name](spark, SF).limit(1).count() == 1
