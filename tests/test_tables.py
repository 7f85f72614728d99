"""Outcomes, payloads, ids, writers and whole jobs."""

import html
import json
from html.parser import HTMLParser

from pyspark.sql import functions as F

from icetally.functions import text
from icetally.operators import cards, feeds, outcomes
from icetally.plans import jobs, match_queries
from icetally.sources import readers, sinks
from icetally.streaming import arrivals


def won(spark, home, away, ot, so, side):
    names = ["p1", "p2", "p3"]
    values = {f"{p}_home_goals": h for p, h in zip(names, home)}
    values |= {f"{p}_away_goals": a for p, a in zip(names, away)}
    values |= {"ot4_home_goals": ot[0], "ot4_away_goals": ot[1]}
    values |= {"so_goals_home": so[0], "so_goals_away": so[1], "player_teamtype": side}
    frame = spark.createDataFrame([tuple(values.values())], list(values))
    return outcomes.outcome_flags(outcomes.outcome_columns(frame)).first()


def test_outcomes(spark):
    row = won(spark, (1, 1, 1), (0, 1, 0), (0, 0), (0, 0), "home")
    assert (row["regulation_winner"], row["ot_winner"], row["so_winner"]) == ("home", "reg", "no_so")
    assert (row["win"], row["loss"], row["regulation_win"]) == (1, 0, 1)
    row = won(spark, (1, 0, 0), (0, 1, 0), (0, 1), (0, 0), "home")
    assert (row["regulation_winner"], row["ot_winner"]) == ("ot", "away")
    assert (row["ot_loss"], row["overtime_loss"], row["loss"]) == (1, 1, 0)
    row = won(spark, (1, 0, 0), (0, 1, 0), (0, 0), (2, 1), "away")
    assert (row["ot_winner"], row["so_winner"], row["shootout_loss"]) == ("so", "home", 1)
    row = won(spark, (1, 0, 0), (0, 1, 0), (0, 0), (2, 2), "away")
    assert row["so_winner"] == "investigate" and row["win"] == 0


def feed(pk, coaches=1, state="Final", message=None, periods=()):
    side = {
        "teamStats": {"teamSkaterStats": {"goals": 2}},
        "players": {
            "ID5": {"person": {"id": 5, "fullName": "A B"}, "position": {"name": "Center"},
                    "stats": {"skaterStats": {"goals": 1, "evenTimeOnIce": "10:00"}}},
        },
        "coaches": [{"person": {"fullName": f"C{i}"}, "position": {"code": "HC"}} for i in range(coaches)],
    }
    doc = {
        "gameData": {
            "game": {"pk": pk, "season": "20212022", "type": "R"},
            "status": {"detailedState": state},
            "players": {"ID5": {"id": 5, "captain": True}},
        },
        "liveData": {
            "boxscore": {"teams": {"away": side, "home": side}, "officials": []},
            "linescore": {"periods": list(periods), "shootoutInfo": {"away": {"scores": 0}}},
        },
    }
    if message is not None:
        doc["messageNumber"] = message
    return (str(pk), json.dumps(doc))


def payloads(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, payload string")


def test_feed_rules(spark):
    rows = payloads(
        spark,
        feed(1, coaches=0),
        feed(2, state="Live"),
        feed(3, message=2),
        feed(4, periods=[{"periodType": "OVERTIME", "num": 5, "home": {"goals": 1}}]),
        feed(5, periods=[{"periodType": "OVERTIME", "num": 4, "home": {"goals": 1}}]),
    )
    info = {r["game_pk"]: r for r in feeds.game_info(feeds.complete_feeds(rows)).collect()}
    assert set(info) == {"1", "4", "5"}
    assert info["1"]["head_coach_home"] is None and info["4"]["head_coach_home"] == "C0"
    assert info["4"]["ot4_home_goals"] is None and info["5"]["ot4_home_goals"] == "1"
    assert info["1"]["arena_id"] == "-999" and info["1"]["so_goals_away"] == "0"
    landed = sinks.stringify(feeds.player_info(feeds.complete_feeds(rows))).first()
    assert landed["captain"] == "True" and landed["alternateCaptain"] == "None"
    several = feeds.game_info(feeds.complete_feeds(payloads(spark, feed(6, coaches=2)))).first()
    assert several["head_coach_home"] is None


def test_cards(spark):
    page = (
        '<div class="player_header">Ann van Berg</div><table id="player_bio_table"><tr>'
        '<td class="bio_title">Team</td><td class="bio_result">TAB</td></tr></table>'
        '<table><tr class="stat_row"><td id="speed">91</td><td id="speed">92</td></tr></table>'
    )
    rows = spark.createDataFrame([(1, page), (2, "<html></html>")], "id long, html string")
    found, other = cards.card_table(rows, "E23", "skater")
    card = found.first()
    assert (card["player_first_name"], card["player_last_name"]) == ("Ann", "van Berg")
    assert card["attributes"] == {"team": "tab", "speed": "92"}
    assert [r["player_id"] for r in other.collect()] == [2]


def test_ids_and_batches(spark):
    assert [r[0] for r in readers.id_range(spark, 5, 8).collect()] == [5, 6, 7]
    wanted = readers.id_range(spark, 5, 8)
    assert readers.missing_ids(wanted, wanted.where("game_id > 5")).first()[0] == 5
    years = spark.createDataFrame([(2021,)], "year int")
    ids = [r["game_id"] for r in readers.playoff_ids(years).collect()]
    assert len(ids) == len(set(ids)) == 15 * 7 and not {"2021030177", "2021030180", "2021030410"} & set(ids)
    assert {"2021030100", "2021030176", "2021030406"} <= set(ids)
    some = spark.createDataFrame([(i * 3,) for i in range(95)], "id long")
    first, later = readers.first_batches(readers.batches(some, 20, block_width=10), 4)
    got = first.collect()
    assert [r["id"] // 3 for r in later.orderBy("id").collect()] == list(range(80, 95))
    wide = spark.createDataFrame([(i * 10_007,) for i in range(500)], "id long")
    deep = readers.batches(wide, 1, block_width=3).collect()
    assert sorted((r["id"], r["batch"]) for r in deep) == [(i * 10_007, i) for i in range(500)]
    many = spark.createDataFrame([(2021, "02", 10_012)], "year int, season_type string, games int")
    numbered = readers.season_ids(many)
    assert numbered.select("game_id").distinct().count() == 10_012
    assert len(got) == 80 and {r["batch"] for r in got if r["id"] < 60} == {0}
    assert max(r["id"] for r in got) == 79 * 3


def test_buckets_and_manifest(spark, tmp_path):
    keys = spark.range(2021020001, 2021021313).withColumnRenamed("id", "game_id")
    sinks.write_bucketed(keys, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == 1312
    assert sorted(r[0] for r in back.select("hashmod").distinct().collect()) == list(range(50))
    assert len(sinks.manifest()) == 12
    pair = spark.range(1).select(sinks.pair_name(F.lit("x zed"), F.lit("y abe"))).first()[0]
    assert pair == "abe_zed"


def test_later_overtimes_decide(spark):
    def period(n, kind, away, home):
        return {"num": n, "periodType": kind, "away": {"goals": away}, "home": {"goals": home}}

    played = [period(n, "REGULAR", 1, 1) for n in (1, 2, 3)]
    played += [period(4, "OVERTIME", 0, 0), period(5, "OVERTIME", 1, 0)]
    rows = payloads(spark, feed(2021030101, periods=played), feed(2021020002, periods=played[:3]))
    info = feeds.game_info(feeds.complete_feeds(rows))
    goals = {r["game_pk"]: (r["overtime_away_goals"], r["overtime_home_goals"]) for r in info.collect()}
    assert goals == {"2021030101": (1, 0), "2021020002": (None, None)}
    stats = feeds.player_stats(feeds.complete_feeds(rows)).withColumn("player_rosterStatus", F.lit("Y"))
    games = outcomes.skater_game_stats(sinks.stringify(stats), sinks.stringify(info))
    won = {r["game_pk"]: r["ot_winner"] for r in outcomes.outcome_columns(games).collect()}
    assert won == {"2021030101": "away", "2021020002": "so"}


def test_numbers_of_any_landed_size(spark):
    frame = spark.createDataFrame([("1000000000",), ("12345678901234567890.5",), ("None",), ("x",)], "v string")
    got = [r[0] for r in frame.select(text.stat(F.col("v"))).collect()]
    assert [None if g is None else str(g.normalize()) for g in got] == ["1E+9", "12345678901234567890.5", "0", None]


def test_character_references(spark):
    page = "<p>Caf&eacute; &#xe9;&#233; &copy; &amp;eacute; &bogus; a&b &lt;i&gt;</p><!-- <a href='no'> --><a href='yes'>"
    row = spark.createDataFrame([(page,)], "v string").select(
        text.html_text(F.col("v")).alias("t"), text.html_links(F.col("v")).alias("l")
    ).first()
    assert row["t"].strip() == "Café éé © &eacute; &bogus; a&b <i>" and row["l"] == ["yes"]


REFERENCES = [
    "&#38;lt;b&#38;gt;", "&#150;&#x96;", "&copy 2020 &copyright; &notit; &amp;amp; R&D a&b & c &", "&#0;&#xD800;&#99999999999999999999;&#1114112;",
    "&#9;x&#1;y&#127;z&#x1F600;", "&#233 &#xe9 &#; &#x; &#xg", "&bogus; &AMP;&AMP &Aacute&eacute;", "no reference", "&&&#65;&lt", "&fjlig;&NotEqualTilde;",
]


def test_references_are_decoded_once(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(REFERENCES)], "i int, t string")
    got = dict(frame.select("i", text.html_text(F.col("t"))).collect())
    assert [got[i] for i in range(len(REFERENCES))] == [html.unescape(t) for t in REFERENCES]


def test_text_and_links_as_a_parser_reads_them(spark):
    page = """<html><head><style>a {}</style><script>var a = "<a href='s'>"; // <!-- </script></head>
    <!-- <a href="c"> --><a class=x href=foo>F &amp; G</a> <A HREF='b?x=1&amp;y=2'>B</a><a data-href="n" href="q">Q</a>
    <a name="n">N</a> 1 < 2 <br/>end</html>"""

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.links, self.words, self.raw = [], [], 0

        def handle_starttag(self, tag, attrs):
            self.raw += tag in ("script", "style")
            if tag == "a" and dict(attrs).get("href"):
                self.links.append(dict(attrs)["href"])

        def handle_endtag(self, tag):
            self.raw -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.raw:
                self.words += data.split()

    reader = Reader()
    reader.feed(page)
    reader.close()
    row = spark.createDataFrame([(page,)], "v string").select(
        text.html_text(F.col("v")).alias("t"), text.html_links(F.col("v")).alias("l")
    ).first()
    assert "".join(row["t"].split()) == "".join(reader.words) and row["l"] == reader.links == ["foo", "b?x=1&y=2", "q"]


def test_unreadable_feeds_are_kept(spark):
    good, cut = feed(1), feed(2)
    rows = payloads(spark, good, ("2", cut[1][:60]), feed(3, coaches=2), ("4", '{"gameData": 7}'), ("5", None), feed(6, message=2))
    readable, rejected = feeds.readable_feeds(rows)
    assert sorted(r["id"] for r in readable.collect()) == ["1", "6"]
    assert sorted(r["id"] for r in rejected.collect()) == ["2", "3", "4", "5"]
    assert rejected.columns == ["id", "payload"]


def test_reports_leave_other_pairs(spark, tmp_path):
    for pair in ("a_b", "c_d", "a_b"):
        frame = spark.createDataFrame([(pair, 1)], "pair string, v int")
        sinks.write_pairs(frame, str(tmp_path / "r"), ["pair"])
    assert sorted(r["pair"] for r in spark.read.parquet(str(tmp_path / "r")).collect()) == ["a_b", "c_d"]


def test_incremental_is_idempotent(spark):
    stored = spark.createDataFrame([("1", "a")], "game_pk string, v string")
    arrived = spark.createDataFrame([("1", "b"), ("2", "c"), ("2", "c")], "game_pk string, v string")
    fresh = readers.incremental_rows(arrived, stored)
    assert [tuple(r) for r in fresh.collect()] == [("2", "c")]
    assert readers.incremental_rows(arrived, stored.union(fresh)).count() == 0


def box_score(game):
    def player(pid, number, position):
        return {
            "playerId": pid, "sweaterNumber": number, "position": position, "plusMinus": 1,
            "name": {"default": f"A. P{pid}"}, "toi": "20:00", "powerPlayToi": "1:00",
            "shorthandedToi": "1:00",
        }

    def side(base):
        return {
            "forwards": [player(base + i, base + i, p) for i, p in enumerate("CLR")],
            "defense": [player(base + 3, base + 3, "D"), player(base + 4, base + 4, "D")],
            "goalies": [player(base + 5, base + 5, "G")],
        }

    doc = {
        "id": game, "awayTeam": {"abbrev": "TAC"}, "homeTeam": {"abbrev": "TAB"},
        "boxscore": {"playerByGameStats": {"awayTeam": side(10), "homeTeam": side(20)}},
    }
    return (str(game), json.dumps(doc))


def play_page(game):
    def on_ice(base):
        return "".join(f"{base + i}\n{p}\n" for i, p in enumerate("CLRDDG"))

    players = on_ice(10) + on_ice(20)
    rest = players.replace("20\nC\n", "29\nC\n")
    shots = [("SHOT", "TAB ONGOAL - #20 P20, Wrist, Off. Zone, 12 ft.", players),
             ("MISS", "TAC #10 P10, Slap, Wide of Net, Off. Zone, 40 ft.", rest)]
    body = "".join(
        f"{i}\n1\nEV\n0:1{i}19:4{i}\n{code}\n{text}\n{ice}" for i, (code, text, ice) in enumerate(shots, 1)
    )
    return (game, f"<html><body>Report\n{body}</body></html>")


def test_jobs_end_to_end(spark, tmp_path):
    root = str(tmp_path)
    odd = [("9", "not json"), ("x9", '{"id": "x9"}'), ("10", '{"id": 10, "awayTeam": 7}')]
    payloads(spark, box_score(1), *odd).write.parquet(f"{root}/box1")
    payloads(spark, box_score(1), box_score(2)).write.parquet(f"{root}/box2")
    pages = spark.createDataFrame([play_page(1), play_page(2)], "game_id long, html string")
    pages.write.parquet(f"{root}/pages")
    jobs.ingest_games(spark, f"{root}/box1", f"{root}/pages", f"{root}/raw")
    # The first game arrives again with the second one and is not added twice.
    jobs.ingest_games(spark, f"{root}/box2", f"{root}/pages", f"{root}/raw", "append")
    plays = spark.read.parquet(f"{root}/raw/plays_with_onice")
    assert plays.count() == 4 and spark.read.parquet(f"{root}/raw/raw_forwards").count() == 12
    assert spark.read.parquet(f"{root}/raw/rejected").count() == 3
    jobs.format_plays(spark, f"{root}/raw")
    jobs.prepare_attempts(spark, f"{root}/raw", f"{root}/ready", 5)
    jobs.attempt_metrics(spark, f"{root}/ready", f"{root}/out")
    before = [spark.read.parquet(f"{root}/out/{t}").count() for t in ("team_player_summary", "team_player_game_detail")]
    jobs.attempt_metrics(spark, f"{root}/ready", f"{root}/out", "TAB", "append")
    after = [spark.read.parquet(f"{root}/out/{t}").count() for t in ("team_player_summary", "team_player_game_detail")]
    assert before == after
    summary = {
        (r["team"], r["playerid"]): r
        for r in spark.read.parquet(f"{root}/out/team_player_summary").collect()
    }
    assert len(summary) == 10
    mine = summary["TAB", 20]
    assert (mine["corsi_for"], mine["rel_corsi_against"], mine["corsi_for_relative_pct"]) == (1, 1, 1)
    assert summary["TAB", 21]["corsi_for"] is None  # never off the ice


def test_summaries_from_sums_equal_the_whole(spark, tmp_path):
    root = str(tmp_path)
    payloads(spark, box_score(1), box_score(2), box_score(3)).write.parquet(f"{root}/box")
    pages = spark.createDataFrame([play_page(n) for n in (1, 2, 3)], "game_id long, html string")
    pages.write.parquet(f"{root}/pages")
    jobs.ingest_games(spark, f"{root}/box", f"{root}/pages", f"{root}/raw")
    jobs.format_plays(spark, f"{root}/raw")
    for name in ("plays_sparse_detail", "raw_forwards", "raw_defense"):
        spark.read.parquet(f"{root}/raw/{name}").where("game_id < 3").write.parquet(f"{root}/part/{name}")
    jobs.add_attempt_games(spark, f"{root}/part", f"{root}/out")
    jobs.add_attempt_games(spark, f"{root}/raw", f"{root}/out")
    jobs.add_attempt_games(spark, f"{root}/raw", f"{root}/out")
    jobs.attempt_metrics(spark, f"{root}/raw", f"{root}/whole")
    read = lambda path: sorted(map(str, spark.read.parquet(f"{root}/{path}/team_player_summary").collect()))
    assert read("out") == read("whole") and len(read("out")) == 10
    count = lambda path: spark.read.parquet(f"{root}/{path}/team_player_game_detail").count()
    # Detail has the players who were off the ice at some attempt, here P20 of each game.
    assert count("out") == count("whole") == 3


def test_feed_jobs_and_arrivals(spark, tmp_path):
    root = str(tmp_path)
    payloads(spark, feed(2021020001), feed(2021020002)).write.parquet(f"{root}/feeds")
    jobs.load_feeds(spark, f"{root}/feeds", f"{root}/landing")
    jobs.load_feeds(spark, f"{root}/feeds", f"{root}/landing", "append")
    assert spark.read.parquet(f"{root}/landing/gameinfo").count() == 2
    stats = spark.read.parquet(f"{root}/landing/playerstats")
    assert stats.count() == 2  # the same player key on both sides of a game is one row

    def load():
        arrivals.load_new_files(
            spark, f"{root}/new", f"{root}/info", f"{root}/checkpoint",
            lambda rows: feeds.game_info(feeds.complete_feeds(rows)), ["game_pk"],
        )

    payloads(spark, feed(1)).write.parquet(f"{root}/new")
    load()
    payloads(spark, feed(1), feed(2)).write.mode("append").parquet(f"{root}/new")
    load()
    load()
    assert sorted(r["game_pk"] for r in spark.read.parquet(f"{root}/info").collect()) == ["1", "2"]


def test_first_append_makes_every_table(spark, tmp_path):
    root = str(tmp_path)
    payloads(spark, feed(2021020001), ("9", "no json")).write.parquet(f"{root}/feeds")
    payloads(spark, box_score(1)).write.parquet(f"{root}/box")
    pages = spark.createDataFrame([play_page(1), play_page(7)], "game_id long, html string")
    pages.write.parquet(f"{root}/pages")
    for _ in range(2):
        jobs.load_feeds(spark, f"{root}/feeds", f"{root}/landing", "append")
        jobs.ingest_games(spark, f"{root}/box", f"{root}/pages", f"{root}/raw", "append")
    count = lambda path: readers.landing_table(spark, f"{root}/{path}").count()
    assert count("landing/gameinfo") == 1 and count("landing/officials") == 0 and count("landing/rejected") == 1
    assert count("raw/plays_with_onice") == 2 and count("raw/raw_forwards") == 6
    waiting = spark.read.parquet(f"{root}/raw/waiting_pages").collect()
    assert [r["game_id"] for r in waiting] == [7]


def test_season_update_reads_one_season(spark, tmp_path):
    root = str(tmp_path)
    games = [feed(f"{year}02000{n}") for year in (2019, 2020, 2021) for n in (1, 2, 3)]
    payloads(spark, *games[:7]).write.parquet(f"{root}/feeds")
    jobs.load_feeds(spark, f"{root}/feeds", f"{root}/landing")
    payloads(spark, *games[6:], feed("2020029999")).write.mode("append").parquet(f"{root}/feeds")
    jobs.update_feeds(spark, f"{root}/feeds", f"{root}/landing", "2021", "R")
    jobs.update_feeds(spark, f"{root}/feeds", f"{root}/landing", "2021", "R")
    found = sorted(r["game_pk"] for r in spark.read.parquet(f"{root}/landing/gameinfo").collect())
    assert found == [json.loads(g[1])["gameData"]["game"]["pk"] for g in games]


def test_increment_prunes_the_stored_seasons(spark, tmp_path):
    rows = [(f"{year}02{n:04d}", n) for year in range(2001, 2021) for n in range(3)]
    stored = spark.createDataFrame(rows, "game_pk string, v int")
    sinks.write_seasons(stored, f"{tmp_path}/t", "game_pk")
    more = [("2003020001", 9), ("2003020007", 9), ("2030020001", 9)]
    arrived = spark.createDataFrame(more, "game_pk string, v int")
    arrived = arrived.withColumn(readers.SEASON_FOLDER, readers.season_of(F.col("game_pk")))
    fresh = readers.incremental_rows(arrived, spark.read.parquet(f"{tmp_path}/t"))
    plan = fresh._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.split("PartitionFilters")[1]
    assert sorted(r["game_pk"] for r in fresh.collect()) == ["2003020007", "2030020001"]
    read = fresh._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression" in read
    mark = readers.high_water_mark(
        spark.read.parquet(f"{tmp_path}/t").selectExpr("*", "left(game_pk, 4) || 'x' season", "'R' game_type"), "2005", "R"
    )
    assert "= y2005" in mark._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert mark.first()["last_pk"] == "2005020002"


def test_bucketed_copies_join_without_exchange(spark, tmp_path):
    plays = spark.range(500).selectExpr("id % 40 game_id", "id v")
    times = spark.range(40).selectExpr("id game_id", "id * 2 t")
    kept = [sinks.save_bucketed(x, f"bucketed_{n}", f"{tmp_path}/{n}", ["game_id"], 4) for n, x in (("p", plays), ("t", times))]
    joined = kept[0].hint("merge").join(kept[1], "game_id").groupBy("game_id").agg(F.sum("v").alias("v"), F.max("t").alias("t"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 40 and joined.agg(F.sum("v")).first()[0] == sum(range(500))


def test_match_up_and_profile_jobs(spark, tmp_path):
    root = str(tmp_path)
    stats, games = match_queries.landing(spark, "/root/testdata/sf0.001")
    stats.write.parquet(f"{root}/landing/playerstats")
    games.write.parquet(f"{root}/landing/gameinfo")
    jobs.match_ups(spark, f"{root}/landing", f"{root}/out")
    rows = spark.read.parquet(f"{root}/out/skater_vs_goaltender")
    assert rows.count() > 0
    jobs.teammate_profiles(spark, f"{root}/out", f"{root}/out", [("Player 1", "Player 3")])
    reports = spark.read.parquet(f"{root}/out/reports").collect()
    assert {r["pair"] for r in reports} == {"1_3"} and len(reports) == 2 * 17
    assert spark.read.parquet(f"{root}/out/sentences").count() == 2
