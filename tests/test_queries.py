"""Every registered query runs; those with a SQL twin give the same rows as DuckDB."""

import pytest

from shelfline.catalog import QUERIES, SQL
from tools.check import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, sf_dir, con):
    rows = QUERIES[name](spark, sf_dir).toArrow()
    assert compare(rows, con.execute(SQL[name]).to_arrow_table()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_names_and_twins():
    assert set(SQL) <= set(QUERIES)


def test_recursion_covers_the_horizon(con):
    """Its rows are held to this twin above."""
    days = con.execute(f"SELECT count(DISTINCT date), max(date) - min(date) FROM ({SQL['g14_recursive_model_28_days']})").fetchone()
    assert days == (28, 27)
