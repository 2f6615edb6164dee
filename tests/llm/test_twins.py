"""The registered queries of the subpackage against their SQL, and the stated columns."""

import pytest

from shelfline.llm.queries import QUERIES, SQL
from tools.check import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, sf_dir, con):
    rows = QUERIES[name](spark, sf_dir).toArrow()
    assert compare(rows, con.execute(SQL[name]).to_arrow_table()) == ""


def test_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
