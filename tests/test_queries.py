"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import differences

from panelrank.queries import oracles, spark_queries
from tests.conftest import SMALL

SQL = oracles()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = spark_queries()[name](spark, SMALL).toPandas()
    problem = differences(got, duck.execute(SQL[name]).df(), allow_empty=True)
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(spark_queries()) - set(SQL)))
def test_runs(spark, name):
    assert spark_queries()[name](spark, SMALL).columns
