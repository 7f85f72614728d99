"""Static properties of the plans of all registered queries."""

import pytest

from icetally.plans.registry import REGISTERED

SF_DIR = "/root/testdata/sf0.001"
WRITES = {"roundtrip_write", "report_paths"}


@pytest.mark.parametrize("name", [n for n in REGISTERED if n not in WRITES])
def test_no_cross_joins_and_no_python(spark, name):
    frame = REGISTERED[name][0](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan


def test_attempts_read_only_their_columns(spark):
    frame = REGISTERED["on_off_share"][0](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    schemas = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema: " in line]
    assert schemas and all("value" not in s and "props" not in s for s in schemas)
    assert frame.columns[:3] == ["game_id", "team", "player_id"]


def plan_of(spark, name):
    return REGISTERED[name][0](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_are_joined_in_place(spark):
    plan = plan_of(spark, "bucketed_detail")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_season_increment_prunes_the_stored_side(spark):
    plan = plan_of(spark, "season_increment")
    assert "dynamicpruningexpression(load_season" in plan


# Planned scans of a query at most.
SCANS = {
    "batches": 3, "card_batches": 6, "append_summary": 2, "versus_opponent": 4, "tenure_games": 6, "impact_report": 8,
    "rank_test": 2, "box_stats": 2, "profile": 2,
    "outcome_flags": 2, "page_attributes": 4,
}


@pytest.mark.parametrize("name", SCANS)
def test_number_of_scans(spark, name):
    assert plan_of(spark, name).count("FileScan") <= SCANS[name]
