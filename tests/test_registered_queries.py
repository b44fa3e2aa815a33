import pytest

import __spark_entry__ as entry_points
import check_oracle

SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_small):
    return check_oracle.connect(sf_small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql_twin(spark, con, sf_small, name):
    df = entry_points.queries()[name](spark, sf_small)
    rows = [tuple(r) for r in df.collect()]
    cursor = con.execute(SQL[name])
    verdict = check_oracle.compare(rows, df.columns, cursor.fetchall(), [d[0] for d in cursor.description])
    assert verdict == "ok"


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(SQL) <= set(entry_points.queries())
