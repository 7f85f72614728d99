import pytest
from pyspark.sql import functions as F

from icetally.functions.arrays import on_ice_codes, split_on_ice
from icetally.functions.text import clock_seconds, elapsed_seconds, html_links, html_text, stat
from icetally.operators import onice, plays as play_ops, playtext

HOME = ["C22", "L4", "R5", "D6", "D7", "G31"]
AWAY = ["C11", "L12", "R13", "D14", "D15", "G30"]
SCHEMA = (
    "game_id long, index string, type string, detail string, home_team string, away_team string,"
    " home_onice_code array<string>, away_onice_code array<string>"
)
TEXTS = [
    ("FAC", "TAB won Neu. Zone - TAC #11 ALPHA vs TAB #22 BRAVO"),
    ("HIT", "TAB #22 BRAVO HIT TAC #11 ALPHA, Off. Zone"),
    ("BLOCK", "TAC #11 ALPHA BLOCKED BY TAB #4 DELTA, Wrist, Def. Zone"),
    ("MISS", "TAB #22 BRAVO, Slap, Wide of Net, Off. Zone, 40 ft."),
    ("MISS", "TAB #22 BRAVO, Slap"),
    ("GIVE", "TAB GIVEAWAY - #22 BRAVO, Def. Zone"),
    ("TAKE", "TAB TAKEAWAY - #99 BRAVO, Off. Zone"),
    ("PENL", "TAB #22 BRAVO Tripping(2 min), Off. Zone Drawn By: TAC #11 ALPHA"),
    ("PENL", "TAB #22 BRAVO Fighting (maj)(5 min), Neu. Zone"),
    ("SHOT", "TAB ONGOAL - #22 BRAVO, Wrist, Off. Zone, 12 ft."),
    ("GOAL", "TAB #22 BRAVO(3), Snap, Off. Zone, 9 ft. Assists: #4 DELTA(7); #5 ECHO(1)"),
    ("GOAL", "TAB #22 BRAVO(3), Snap, Off. Zone, 9 ft."),
    ("STOP", "ICING"),
    (None, "ICING"),
    *[(code, None) for code in ("FAC", "HIT", "BLOCK", "MISS", "GIVE", "PENL", "GOAL", "SHOT")],
]


@pytest.fixture(scope="module")
def plays(spark):
    rows = [
        (1, str(i), code, text, "TAB", "TAC", HOME, AWAY) for i, (code, text) in enumerate(TEXTS)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def sparse(plays):
    return {int(r["index"]): r.asDict() for r in play_ops.sparse_union(plays).collect()}


def filled(row):
    keys = SCHEMA.replace(",", "").split()[::2]
    return {k: v for k, v in row.items() if v is not None and k not in keys}


def test_sparse_row_count(plays, sparse):
    assert len(sparse) == len(TEXTS)


def test_faceoff(sparse):
    assert filled(sparse[0]) == {
        "zone": "Neu. Zone",
        "faceoff_win_team": "TAB",
        "faceoff_taken_by_away": "TAC #11 ALPHA",
        "faceoff_taken_by_home": "TAB #22 BRAVO",
        "faceoff_taken_by_away_index": 1,
        "faceoff_taken_by_home_index": 1,
        "faceoff_winner_home": True,
    }


def test_hit(sparse):
    assert filled(sparse[1]) == {
        "zone": "Off. Zone",
        "hitter": "TAB #22 BRAVO",
        "hitter_team": "TAB",
        "home_hitter": True,
        "hitter_onice_index": 1,
        "hittee": "TAC #11 ALPHA",
        "hittee_team": "TAC",
        "hittee_onice_index": 1,
    }


def test_block(sparse):
    row = filled(sparse[2])
    assert (row["shooter"], row["blocker"]) == ("TAC #11 ALPHA", "TAB #4 DELTA")
    assert (row["home_shooter"], row["home_blocker"]) == (False, True)
    assert (row["shooter_onice_index"], row["blocker_onice_index"]) == (1, 2)
    assert (row["shot_type"], row["block_location"]) == ("Wrist", "Def. Zone")
    assert row["shot_result"] == "Blocked" and "zone" not in row


def test_miss(sparse):
    row = filled(sparse[3])
    assert (row["shot_result"], row["zone"], row["shot_distance"]) == (
        "Wide of Net",
        "Off. Zone",
        "40 ft.",
    )
    short = filled(sparse[4])
    assert short["shot_type"] == "Slap"
    assert not {"shot_result", "zone", "shot_distance"} & short.keys()


def test_possession(sparse):
    give, take = filled(sparse[5]), filled(sparse[6])
    assert (give["giveaway_player"], give["zone"]) == ("TAB #22 BRAVO", "Def. Zone")
    assert give["giveaway_player_onice_index"] == 1
    assert (take["takeaway_player"], take["takeaway_player_onice_index"]) == ("TAB #99 BRAVO", 0)


def test_penalty(sparse):
    row = filled(sparse[7])
    assert row["penalty_committed_by"] == "TAB #22 BRAVO"
    assert row["penalty_drawn_by"] == "TAC #11 ALPHA"
    assert (row["penalty_detail"], row["penalty_duration"], row["maj_flag"]) == ("Tripping", "2 min", 0)
    assert row["zone"] == "Off. Zone"
    major = filled(sparse[8])
    assert (major["penalty_detail"], major["penalty_duration"], major["maj_flag"]) == (
        "Fighting",
        "5 min",
        1,
    )
    assert "penalty_drawn_by" not in major


def test_shot(sparse):
    row = filled(sparse[9])
    assert (row["shooter"], row["shooter_team"], row["shot_result"]) == (
        "TAB #22 BRAVO",
        "TAB",
        "On-Goal",
    )


def test_goal(sparse):
    row = filled(sparse[10])
    assert (row["shooter"], row["shot_result"], row["shot_distance"]) == (
        "TAB #22 BRAVO",
        "Goal",
        "9 ft.",
    )
    assert (row["primary_assist_player"], row["secondary_assist_player"]) == (
        "TAB #4 DELTA",
        "TAB #5 ECHO",
    )
    assert (
        row["goal_scorer_num_goals"],
        row["primary_assistor_num_assists"],
        row["secondary_assistor_num_assists"],
    ) == (3, 7, 1)
    alone = filled(sparse[11])
    assert "primary_assist_player" not in alone and "primary_assistor_num_assists" not in alone


def test_unparsed_codes_stay_empty(sparse):
    assert filled(sparse[12]) == {} and filled(sparse[13]) == {}


def test_single_pass_equals_union_of_branches(plays):
    one, many = play_ops.sparse_union(plays), play_ops.sparse_union_by_branch(plays)
    assert one.schema == many.select(*one.columns).schema
    assert one.exceptAll(many.select(*one.columns)).count() == 0
    assert many.count() == one.count()


def test_single_pass_has_one_scan_and_no_shuffle(spark, plays, tmp_path):
    plays.write.parquet(str(tmp_path / "plays"))
    frame = play_ops.sparse_union(spark.read.parquet(str(tmp_path / "plays")))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "Exchange" not in plan and "Python" not in plan


def test_type_filter_reaches_the_scan(spark, plays, tmp_path):
    plays.write.parquet(str(tmp_path / "plays"))
    frame = play_ops.parse_type(spark.read.parquet(str(tmp_path / "plays")), "HIT")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(type,HIT)" in plan


def tokens(codes):
    return [part for code in codes for part in (code[1:], code[0])]


@pytest.mark.parametrize(
    "on_ice, away, home",
    [
        (tokens(AWAY + HOME), tokens(AWAY), tokens(HOME)),
        (tokens(AWAY[:4]), [], []),
        # Away goalie off, eleven players: cut after n + 1 tokens.
        (tokens(AWAY[:5] + ["D9"] + HOME[1:]), tokens(AWAY[:5] + ["D9"]), tokens(HOME[1:])),
        # Twelve players and only the home goalie: no safe cut.
        (tokens(AWAY[:5] + ["D9"] + HOME), [], []),
        (tokens([c for c in AWAY + HOME if c[0] != "G"] + ["D8"]), [], None),
        ([], [], []),
    ],
)
def test_split_on_ice(spark, on_ice, away, home):
    frame = spark.createDataFrame([(on_ice,)], "on_ice array<string>")
    got = frame.select(*split_on_ice(F.col("on_ice"))).first()
    assert got[0] == away
    assert got[1] == (on_ice if home is None else home)


def test_codes_and_clocks(spark):
    frame = spark.createDataFrame([(["11", "C", "30", "G", "7"],)], "t array<string>")
    assert frame.select(on_ice_codes(F.col("t"))).first()[0] == ["C11", "G30"]
    clocks = spark.createDataFrame([("12:34",), ("12",), ("a:b",), (None,)], "c string")
    assert [r[0] for r in clocks.select(clock_seconds(F.col("c"))).collect()] == [754, None, None, None]
    assert clocks.select(elapsed_seconds(F.lit("3"), F.col("c"))).first()[0] == 3154
    values = spark.createDataFrame([("2",), ("None",), (None,), ("x",)], "v string")
    assert [r[0] for r in values.select(stat(F.col("v")).cast("double")).collect()] == [2, 0, 0, None]


def test_html(spark):
    page = (
        '<!DOCTYPE html><p>a<b>b</b> &amp;lt; &#233;&nbsp;<!-- <p>no --><script>x="</p>"</script>'
        '<a class=x HREF="/one">1</a><a href=\'/two\'>2</a></p>'
    )
    frame = spark.createDataFrame([(page,)], "html string")
    text, links = frame.select(html_text(F.col("html")), html_links(F.col("html"))).first()
    assert text == "ab &lt; é 12"
    assert links == ["/one", "/two"]


def test_tokenize(spark):
    text = (
        "Report\n1\n1\nEV\n0:0020:00\nPSTR\nPeriod start\n\n \n11\nC\n30\nG\n\n"
        "2\n1\nPP\n0:1519:45\nSHOT\nTAB ONGOAL - #22 BRAVO, Wrist, Off. Zone, 12 ft.\n4\nD\n31\nG\n"
        "(C) Copyright league\nmore\n"
    )
    documents = spark.createDataFrame(
        [(7, "TAC", "TAB", text), (8, "TAC", "TAB", "no events")],
        "game_id long, away_team string, home_team string, text string",
    )
    first, second = sorted(playtext.raw_plays(playtext.tokenize_plays(documents)).collect(), key=lambda r: r["index"])
    assert (first["index"], first["period"], first["status"]) == ("1", "1", "EV")
    assert (first["time_elapsed"], first["time"], first["type"]) == ("0:00", "20:00", "PSTR")
    assert first["on_ice"] == ["11", "C", "30", "G"]
    assert (second["time_elapsed"], second["time"], second["time_elapsed_s"]) == ("0:15", "19:45", 15)
    assert second["on_ice"] == ["4", "D", "31", "G"]


def test_attach_on_ice(spark):
    plays = spark.createDataFrame(
        [
            (1, "TAC", "TAB", "1", None, tokens(["C11", "L99"]), tokens(["D6", "C22"])),
            (1, "TAC", "TAB", "2", "x", [], []),
            (1, "TAC", "TAB", "3", "x", tokens(["C88"]), tokens(["C22"])),
            (2, "TAC", "TAB", "1", "x", tokens(["C11"]), tokens(["C22"])),
        ],
        "game_id long, away_team string, home_team string, index string, detail string,"
        " away_onice_array1 array<string>, home_onice_array1 array<string>",
    )
    for name in ("period", "status", "type", "time", "time_elapsed"):
        plays = plays.withColumn(name, F.lit("x"))
    plays = plays.withColumn("on_ice", F.array(F.lit("x"))).withColumn("time_elapsed_s", F.lit(0))
    roster = "game_id long, side string, position string, sweaterNumber long, playerId long, name map<string,string>"
    forwards = spark.createDataFrame(
        [
            (1, "TAC", "C", 11, 111, {"default": "A. ALPHA"}),
            (1, "TAB", "C", 22, 222, {"default": "B. VAN BRAVO"}),
        ],
        roster,
    )
    defense = spark.createDataFrame([(1, "TAB", "D", 6, 206, {"default": "D. DELTA"})], roster)
    goalies = spark.createDataFrame([], roster)
    rows = {
        (r["game_id"], r["index"]): r
        for r in onice.attach_on_ice(plays, forwards, defense, goalies).collect()
    }
    assert set(rows) == {(1, "1"), (1, "2"), (1, "3")}
    first = rows[1, "1"]
    assert first["home_onice_code"] == ["D6", "C22"] and first["home_onice_ids"] == ["206", "222"]
    assert first["home_onice_names"] == ["DELTA", "VAN BRAVO"]
    assert first["away_onice_code"] == ["C11"] and first["away_onice_firstinit"] == ["A"]
    assert rows[1, "2"]["home_onice_code"] == [] and rows[1, "2"]["away_onice_ids"] == []
    assert rows[1, "3"]["away_onice_code"] is None and rows[1, "3"]["home_onice_code"] == ["C22"]
