"""The registry, and plan checks on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from rostrum.catalog.registry import COVERS

SMALL = "/root/testdata/sf0.001"


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150
    assert {i for ids in COVERS.values() for i in ids} >= {"AGG-1", "DUP-1", "GR-1", "JN-5", "PG-6", "RK-1", "STR-1", "STR-2"}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the data folder")
def test_flagship(spark):
    df = entry.entry(spark)
    assert "rank" in df.columns and df.count() == 50


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the data folder")
@pytest.mark.parametrize("name", ["speaker_leaderboard", "top_talks_per_speaker", "mentions", "facet_counts", "trending_items", "related_calls", "top_matches_by_user"])
def test_no_cross_joins(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the data folder")
def test_top_k_is_cut_before_the_shuffle(spark):
    plan = entry.queries()["top_talks_per_speaker"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["call_benefits", "clean_call_texts", "call_metadata"])
def test_mining_of_one_small_file_is_dealt_over_all_cores(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
