import random

import pytest

from icetally.operators import attempts
from icetally.schemas import ATTEMPT_TYPES

SCHEMA = (
    "game_id long, home_team string, away_team string, status string, type string,"
    " shooter_team string, home_onice_ids array<string>, away_onice_ids array<string>"
)


def make_rows():
    rnd = random.Random(3)
    rows = []
    for _ in range(600):
        # One game holds half of all plays.
        game = 1 if rnd.random() < 0.5 else rnd.randint(2, 6)
        home, away = ("AAA", "BBB") if game % 2 else ("CCC", "AAA")
        ids = [str(i) for i in range(12)]
        lists = [rnd.sample(ids[:7], 3), rnd.sample(ids[5:], 3)]
        lists = [x if rnd.random() > 0.1 else rnd.choice([None, []]) for x in lists]
        kind = rnd.choice([*ATTEMPT_TYPES, "HIT"])
        rows.append((game, home, away, "EV", kind, rnd.choice([home, away, None]), *lists))
    return rows


ROWS = make_rows()


def literal(game, team, player):
    """The two filters written out, with a missing list satisfying neither."""
    out = {"on": {"for": 0, "against": 0}, "off": {"for": 0, "against": 0}}
    for g, home, away, _, kind, shooter, h, a in ROWS:
        if g != game or team not in (home, away) or kind not in ATTEMPT_TYPES:
            continue
        way = "for" if shooter == team else "against"
        if player in (h or []) or player in (a or []):
            out["on"][way] += 1
        elif h is not None and a is not None:
            out["off"][way] += 1
    return out


@pytest.fixture(scope="module")
def plays(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_matches_the_literal_filters(plays):
    got = {
        (r["game_id"], r["team"], r["player_id"]): r
        for r in attempts.player_attempts_by_game(plays).collect()
    }
    expected = set()
    for game in range(1, 7):
        for team in ("AAA", "BBB", "CCC"):
            for player in map(str, range(12)):
                want = literal(game, team, player)
                if sum(want["on"].values()) and sum(want["off"].values()):
                    expected.add((game, team, player))
                    row = got[game, team, player]
                    assert (row["corsi_for"], row["corsi_against"]) == tuple(want["on"].values())
                    assert (row["rel_corsi_for"], row["rel_corsi_against"]) == tuple(
                        want["off"].values()
                    )
    assert set(got) == expected


def box(spark):
    rows = [
        (g, p, side, {"default": f"P. {p}"}, 1, pp, "1:00", toi, "C")
        for g, side, p, toi, pp in [
            (1, "AAA", 0, "20:00", "2:00"),
            (3, "AAA", 0, "3:00", "2:00"),
            (1, "BBB", 9, "10:30", "0:00"),
            (2, "AAA", 0, None, "0:00"),
        ]
    ]
    schema = (
        "game_id long, playerid long, side string, name map<string,string>, plusminus long,"
        " powerplaytoi string, shorthandedtoi string, toi string, position string"
    )
    frame = spark.createDataFrame(rows, schema)
    return frame, frame.limit(0)


def test_rates_and_summary(spark, plays):
    toi = attempts.skater_toi(*box(spark))
    detail = attempts.game_detail(plays, toi)
    rows = {(r["game_id"], r["player_id"]): r for r in detail.collect()}
    assert rows[1, "0"]["evenstrengthtoi_s"] == 17 * 60
    assert rows[1, "0"]["corsi_for_per_es60"] == pytest.approx(
        rows[1, "0"]["corsi_for"] * 3600 / 1020
    )
    assert rows[3, "0"]["corsi_per_es60"] is None  # no even-strength time
    summary = {r["playerid"]: r for r in attempts.team_summary(detail, toi).collect()}
    mine = [r for (g, p), r in rows.items() if p == "0"]
    assert summary[0]["corsi_for"] == pytest.approx(sum(r["corsi_for"] for r in mine) / len(mine))
    assert summary[0]["games_played"] == 3 and summary[0]["plusminus"] == len(mine)
    one = attempts.game_detail(plays, toi, team="BBB").collect()
    assert {r["team"] for r in one} == {"BBB"}


def test_teams_and_players(spark):
    toi = attempts.skater_toi(*box(spark))
    teams = {r["side"]: r for r in attempts.teams_key(toi).collect()}
    assert teams["AAA"]["games_played"] == 3 and teams["AAA"]["toi_s"] == 23 * 60
    assert attempts.players_key(toi, "BBB").first()["name"] == "P. 9"
