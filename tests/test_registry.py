"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from compare import as_pandas, differences, duck
from helpers import plan

SF = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
    assert {q for q in set(QUERIES) - set(SQL) if not q.startswith("op")} <= {"pipeline"}


# Selectors vary by row.
PYTHON = {"clean_article_by_pattern"}
# The corpus operators have tests of their own.
READER = sorted(q for q in QUERIES if not q.startswith("op") and q != "pipeline")
# Ranks of the n highest numbers only.
WHOLE_WINDOW = {"hot_links"}


def check_plan(name, text):
    assert "CartesianProduct" not in text
    assert "NestedLoopJoin" not in text
    assert ("EvalPython" in text) == (name in PYTHON)
    for line in text.splitlines():
        if " Window [" in line:
            # A window prints its partition columns, then its order.
            assert ("], [" in line) or name in WHOLE_WINDOW, line


@pytest.mark.parametrize("name", READER)
def test_query_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    check_plan(name, plan(df))
    got = as_pandas(df)
    if name in SQL:
        assert differences(got, con.execute(SQL[name]).df()) is None
    else:
        assert len(got) > 0


def test_entry_gives_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns[0] == "group_id"
    assert df.count() > 0
