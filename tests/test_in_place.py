"""What is moved, parsed or written once, and how tasks share the work."""

import re

import pytest
from pyspark.sql import functions as F

from icetally.operators import cards, outcomes
from icetally.plans import feed_queries
from icetally.plans.registry import REGISTERED
from icetally.sources import sinks

SF_DIR = "/root/testdata/sf0.001"


def query_execution(frame):
    return frame._jdf.queryExecution()


@pytest.mark.parametrize("name", ["versus_opponent", "points_columns", "outcome_flags"])
def test_rows_stored_by_game_stay_in_place(spark, name):
    plan = query_execution(REGISTERED[name][0](spark, SF_DIR)).executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_stored_games_are_not_broadcast(spark):
    """A column that is read alone is taken for a small share of the files, with any number of games."""
    games = spark.range(40).select(F.col("id").cast("string").alias("game_pk"), *[F.lit("x").alias(f"c{n}") for n in range(5)])
    left, right = outcomes.by_game(games, "left"), outcomes.by_game(games, "right")
    for how in ("inner", "left"):
        joined = left.join(right.where("c1 = 'x'").select("game_pk", "c2"), "game_pk", how)
        plan = query_execution(joined).executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan and "Exchange" not in plan
        assert joined.count() == 40


@pytest.mark.parametrize("name", ["versus_opponent", "points_columns", "outcome_flags", "tenure_games"])
def test_games_of_a_query_are_not_broadcast(spark, name):
    plan = query_execution(REGISTERED[name][0](spark, SF_DIR)).executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[game_pk", plan)


@pytest.mark.parametrize("name", ["tenure_games", "pair_tenure"])
def test_pairs_take_no_window_of_their_own(spark, name):
    plan = query_execution(REGISTERED[name][0](spark, SF_DIR)).optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if re.search(r"[+:] *-? *Window |^ *Window ", line)]
    assert windows and not any("player_a" in line for line in windows)


def test_distinct_rows_of_some_columns(spark):
    rows = [("g1", "x", None, "1"), ("g1", None, "x", "1"), ("g1", "x", None, "1"), ("g1", "x", None, "2"), (None, "x", "x", "3")]
    df = spark.createDataFrame(rows, "game_pk string, a string, b string, c string")
    found = outcomes.distinct_by_game(df, ["game_pk", "c"]).collect()
    assert sorted(map(tuple, found)) == [("g1", "1"), ("g1", "1"), ("g1", "2")]


def test_numbers_in_place_are_those_of_the_rows(spark):
    keys = [("p", "02", "2020", "2020020001"), ("p", "02", "2020", "2020020002"), ("p", "02", "2020", "2020020002"),
            ("p", "02", "2021", "2021020001"), ("q", "02", "2020", "2020020002"), (None, "02", "2020", "2020020001")]
    rows = [(*k, n) for n, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "player_id string, game_type string, game_season string, game_pk string, n int")
    plain, placed = outcomes.game_numbers(df), outcomes.game_numbers(outcomes.by_game(df, "rows"), in_place=True)
    assert plain.columns == placed.columns
    read = lambda frame: sorted(tuple(r) for r in frame.drop("n").collect())
    assert read(plain) == read(placed) and len(read(placed)) == 5
    assert [r[-2:] for r in read(placed) if r[0] == "p"] == [(1, 1), (2, 2), (3, 3), (4, 1)]


def test_reports_are_dealt_over_tasks(spark, tmp_path):
    pairs = spark.range(40).select(
        F.concat(F.lit("a "), "id").alias("player_a"), F.concat(F.lit("b "), "id").alias("player_b")
    )
    tenures = pairs.withColumns({"first_game": F.lit("1"), "last_game": F.lit("2")})
    report = pairs.select("*", F.explode(F.array("player_a", "player_b")).alias("player_last_name"))
    sinks.write_reports(report, tenures, str(tmp_path))
    files = [p.name for p in tmp_path.rglob("part-*.parquet")]
    assert len(files) == 80 and len({name[:10] for name in files}) > 4


def test_folders_of_a_pair_are_written_by_one_task(spark, tmp_path):
    pairs = spark.range(40).select(F.concat(F.lit("p"), "id").alias("pair"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("player"))
    sinks.write_pairs(pairs.withColumn("v", F.lit(1)), str(tmp_path / "r"), ["pair", "player"])
    folders = list((tmp_path / "r").glob("pair=*"))
    assert len(folders) == 40
    assert all(len({p.name[:10] for p in f.rglob("part-*.parquet")}) == 1 for f in folders)
    sinks.write_pairs(pairs.where("pair = 'p7' and player = 2").withColumn("v", F.lit(2)), str(tmp_path / "r"), ["pair", "player"])
    found = spark.read.parquet(str(tmp_path / "r"))
    assert (found.count(), found.where("v = 2").count()) == (240, 1)


def test_report_folders_are_read_by_few_tasks(spark):
    frame = REGISTERED["report_paths"][0](spark, SF_DIR)
    assert frame.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_card_patterns_are_matched_once(spark):
    pages = spark.createDataFrame([(1, "x")], "id long, html string")
    plan = query_execution(cards.card_rows(pages, "skater", "id")).optimizedPlan().toString()
    assert plan.count(cards.BIO_RESULT) == plan.count(cards.SKATER_STAT) // 2 == 1


@pytest.mark.parametrize("name", ["complete_feeds", "player_info", "array_rows"])
def test_payloads_are_parsed_once(spark, name):
    frame = getattr(feed_queries, name)(spark, SF_DIR)
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 26))
    plan = query_execution(frame).optimizedPlan().toString()
    assert plan.count("from_json(") == 1
