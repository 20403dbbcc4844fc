"""Rules over all lengths, beside the queries over pairs."""

import pytest

from panelrank.operators import rules
from panelrank.queries import spark_queries
from tests.conftest import SMALL


@pytest.mark.parametrize(
    "name, column, least",
    [("frequent_itemsets", "items", 2), ("association_rules", "antecedent", 1), ("non_redundant_association_rules", "antecedent", 1)],
)
def test_longer_sets_are_kept(spark, name, column, least):
    rows = spark_queries()[name](spark, SMALL).collect()
    assert any(r[column].count("|") >= least for r in rows)


def test_mined_once(spark):
    """Sets and rules are read from what was mined, not mined again by every use; baskets move once."""
    rows = [(k, x) for k in range(40) for x in ("ab", "abc", "bc", "c")[k % 4]] + [(50, None), (None, "a"), (None, "b")]
    bought = spark.createDataFrame(rows, "id long, item string")
    tree = spark.createDataFrame([("a", "up"), ("b", "up"), ("d", "up")], "item string, ancestor string")
    encoded = rules.encode_taxonomy(bought, tree, "id", "item")
    got = {r.id: r["items"] for r in encoded.collect()}
    assert got[0] == ["a", "b", "up"] and got[3] == ["c"] and got[50] == [] and got[None] == ["a", "b", "up"]
    assert encoded._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [id") == 1
    sets, found = rules.frequent_itemsets(encoded, 0.2, 0.3)
    for df in (sets, found):
        assert "RDD" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r["items"]): r.freq for r in sets.collect()}[("a", "b", "up")] == 21
    assert {(tuple(r.antecedent), r.consequent): r.confidence for r in found.collect()}[("a",), "b"] == 1
