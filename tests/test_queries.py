"""Every registered query against its SQL, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as entry
import oracle
from concord import plans

QUERIES = {name: run for name, run in entry.queries().items() if name in plans.registered()}
ORACLES = plans.oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, sf_dir, name):
    assert oracle.difference(spark, con, QUERIES[name], ORACLES[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_plan_has_no_product_and_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|EvalPython|InPandas", plan)


@pytest.mark.parametrize(("name", "key"), [("match_capabilities", "provider"), ("validate_workloads", "provider"), ("match_subscriptions", "__key")])
def test_facts_are_not_shuffled_for_a_short_list(spark, sf_dir, name, key):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and f"hashpartitioning({key}" not in plan
    assert plan.count("from_json") <= 2  # the document, and its keys where a null is in doubt
