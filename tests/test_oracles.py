"""Every query with an oracle gives the same rows as DuckDB on the small tables."""

import compare
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from duelframe.plans import registry

ORACLES = registry.ORACLES  # those of the corpus operators are compared in their own tests
QUERIES = registry.QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_oracle(name, spark, sf, con):
    problem = compare.difference(QUERIES[name](spark, sf), con, ORACLES[name])
    assert problem is None, problem


def test_entry_and_names(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_opponents_without_cartesian_product(spark, sf):
    for name in ("common_opponent", "h2h_prior", "pair_wide", "inplay_prob"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_windows_share_one_shuffle(spark, sf):
    """Groupings that start with the player add sorts, not exchanges."""
    from duelframe.operators.history import player_history
    from duelframe.plans import stages

    plan = player_history(stages.sides(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_filters_reach_the_scan(spark, sf):
    from duelframe.plans import fixtures as fx

    df = fx.contests(spark, sf).filter(F.col("tour") == "ASIA").select("match_num")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(tour), EqualTo(tour,ASIA)]" in plan and "loser_name" not in plan
