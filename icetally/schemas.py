"""Declared schemas of the published tables and of the landed JSON payloads.

The names below are fixed values: they are the published column and payload key names.
"""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "names": T.MapType(T.StringType(), T.StringType()),
}


def _columns(text: str) -> T.StructType:
    """Flat schema from ``name type`` pairs; usable without a running session."""
    pairs = (pair.split() for pair in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Play table, first twelve columns of every play-level table.
PLAY_KEY = ["game_id", "index"]
PLAY_COLUMNS = [
    "game_id",
    "away_team",
    "home_team",
    "index",
    "period",
    "status",
    "type",
    "detail",
    "time",
    "time_elapsed",
    "on_ice",
    "time_elapsed_s",
]

# Event codes that have their own parser; every other code is kept unparsed.
PARSED_TYPES = ["SHOT", "GOAL", "FAC", "BLOCK", "GIVE", "HIT", "MISS", "PENL", "TAKE"]
ATTEMPT_TYPES = ["GOAL", "SHOT", "BLOCK", "MISS"]

# Event columns of the sparse play table.
SPARSE_EVENT_COLUMNS = _columns(
    """
    zone string, shot_type string, shot_distance string, shooter string, shooter_team string,
    home_shooter boolean, shooter_onice_index int, shot_result string,
    blocker string, block_location string, blocker_team string, home_blocker boolean,
    blocker_onice_index int,
    primary_assist_player string, secondary_assist_player string, goal_scorer_num_goals int,
    primary_assistor_num_assists int, secondary_assistor_num_assists int,
    primary_assist_player_onice_index int, secondary_assist_player_onice_index int,
    faceoff_taken_by_away string, faceoff_taken_by_home string, faceoff_taken_by_away_index int,
    faceoff_taken_by_home_index int, faceoff_winner_home boolean, faceoff_win_team string,
    hitter string, hittee string, hitter_team string, hittee_team string, home_hitter boolean,
    hitter_onice_index int, hittee_onice_index int,
    takeaway_player string, takeaway_player_team string, home_takeaway_player boolean,
    takeaway_player_onice_index int,
    giveaway_player string, giveaway_player_team string, home_giveaway_player boolean,
    giveaway_player_onice_index int,
    penalty_drawn_by string, penalty_committed_by string, penalty_committed_by_team string,
    penalty_drawn_by_team string, penalty_detail string, maj_flag int, penalty_duration string,
    home_penalty_committed_by boolean, penalty_committed_by_onice_index int,
    penalty_drawn_by_onice_index int
    """
)

# Box score keys of forwards and defensemen, and of goalies.
SKATER_BOX = _columns(
    """
    playerId bigint, sweaterNumber bigint, name names, position string, goals bigint,
    assists bigint, points bigint, plusMinus bigint, pim bigint, hits bigint, blockedShots bigint,
    powerPlayGoals bigint, powerPlayPoints bigint, shorthandedGoals bigint, shPoints bigint,
    shots bigint, faceoffs string, faceoffWinningPctg double, toi string, powerPlayToi string,
    shorthandedToi string
    """
)
GOALIE_BOX = _columns(
    """
    playerId bigint, sweaterNumber bigint, name names, position string,
    evenStrengthShotsAgainst string, powerPlayShotsAgainst string, shorthandedShotsAgainst string,
    saveShotsAgainst string, savePctg string, evenStrengthGoalsAgainst bigint,
    powerPlayGoalsAgainst bigint, shorthandedGoalsAgainst bigint, pim bigint, goalsAgainst bigint,
    toi string
    """
)

_SKATERS = f"array<{SKATER_BOX.simpleString()}>"
_SIDE_BOX = f"struct<forwards:{_SKATERS},defense:{_SKATERS},goalies:array<map<string,string>>>"
BOX_SCORE = f"""
    id bigint, season string, gameType string, gameDate string, venue string, startTimeUTC string,
    easternUTCOffset string, venueUTCOffset string, gameScheduleState string, period string,
    gameOutcome struct<lastPeriodType:string>,
    awayTeam map<string,string>, homeTeam map<string,string>,
    boxscore struct<playerByGameStats:struct<awayTeam:{_SIDE_BOX},homeTeam:{_SIDE_BOX}>>
    """

# Keys of the team listing.
TEAM_LISTING = """
    id bigint, name string, venue struct<name:string,city:string>, abbreviation string,
    teamName string, locationName string, firstYearOfPlay string,
    division struct<id:bigint,name:string>, conference struct<id:bigint,name:string>,
    shortName string, franchiseId bigint
    """

# Keys of the live game feed, all read as text.
SKATER_STATS = [
    "assists",
    "goals",
    "shots",
    "hits",
    "powerPlayGoals",
    "powerPlayAssists",
    "penaltyMinutes",
    "faceOffPct",
    "faceOffWins",
    "faceoffTaken",
    "takeaways",
    "giveaways",
    "shortHandedGoals",
    "shortHandedAssists",
    "blocked",
    "plusMinus",
    "evenTimeOnIce",
    "powerPlayTimeOnIce",
    "shortHandedTimeOnIce",
]
GOALIE_STATS = [
    "timeOnIce",
    "assists",
    "goals",
    "pim",
    "shots",
    "saves",
    "powerPlaySaves",
    "shortHandedSaves",
    "evenSaves",
    "shortHandedShotsAgainst",
    "evenShotsAgainst",
    "powerPlayShotsAgainst",
    "decision",
    "savePercentage",
    "evenStrengthSavePercentage",
]


def _text_struct(*names: str, **nested: str) -> str:
    parts = [f"{n}:string" for n in names] + [f"{n}:{t}" for n, t in nested.items()]
    return f"struct<{','.join(parts)}>"


_PERSON = _text_struct("id", "fullName")
_TEAM = _text_struct("id", "name", "shortName")
_PLAYER_INFO = _text_struct(
    "id",
    "fullName",
    "firstName",
    "lastName",
    "primaryNumber",
    "birthDate",
    "currentAge",
    "birthCity",
    "birthStateProvince",
    "birthCountry",
    "nationality",
    "height",
    "weight",
    "active",
    "captain",
    "alternateCaptain",
    "rookie",
    "shootsCatches",
    "rosterStatus",
    currentTeam=_text_struct("id", "name", "triCode"),
    primaryPosition=_text_struct("code", "name", "type", "abbreviation"),
)
_PLAYER_BOX = _text_struct(
    "jerseyNumber",
    person=_text_struct("id", "fullName", "shootsCatches", "rosterStatus"),
    position=_text_struct("code", "name", "type", "abbreviation"),
    stats=_text_struct(
        skaterStats=_text_struct(*SKATER_STATS), goalieStats=_text_struct(*GOALIE_STATS)
    ),
)
_SIDE_TEAM_STATS = _text_struct(
    "goals",
    "pim",
    "shots",
    "powerPlayPercentage",
    "powerPlayGoals",
    "powerPlayOpportunities",
    "faceOffWinPercentage",
    "blocked",
    "takeaways",
    "giveaways",
    "hits",
)
_SIDE = _text_struct(
    teamStats=f"struct<teamSkaterStats:{_SIDE_TEAM_STATS}>",
    players=f"map<string,{_PLAYER_BOX}>",
    coaches="array<struct<person:struct<fullName:string>,position:struct<code:string>>>",
)
_PERIOD_SIDE = _text_struct("goals", "shotsOnGoal", "rinkSide")
_SHOOTOUT_SIDE = _text_struct("attempts", "scores")
_PLAY = _text_struct(
    result=_text_struct("event", "eventCode", "eventTypeId", "description"),
    about=_text_struct(
        "eventIdx",
        "eventId",
        "period",
        "periodType",
        "ordinalNum",
        "periodTime",
        "periodTimeRemaining",
        "dateTime",
        "goals",
    ),
    coordinates=_text_struct("x", "y"),
)
LIVE_FEED = f"""
    messageNumber bigint,
    gameData struct<
      game:{_text_struct("pk", "season", "type")},
      datetime:{_text_struct("dateTime", "endDateTime")},
      status:{_text_struct("detailedState", "startTimeTBD")},
      teams:struct<away:{_TEAM},home:{_TEAM}>,
      players:map<string,{_PLAYER_INFO}>,
      venue:{_text_struct("id", "name")}>,
    liveData struct<
      decisions:struct<winner:{_PERSON},loser:{_PERSON},firstStar:{_PERSON},
        secondStar:{_PERSON},thirdStar:{_PERSON}>,
      boxscore:struct<teams:struct<away:{_SIDE},home:{_SIDE}>,
        officials:array<struct<official:{_text_struct("id", "fullName", "officialType")}>>>,
      plays:struct<allPlays:array<{_PLAY}>>,
      linescore:struct<
        periods:array<struct<periodType:string,num:int,away:{_PERIOD_SIDE},home:{_PERIOD_SIDE}>>,
        shootoutInfo:struct<away:{_SHOOTOUT_SIDE},home:{_SHOOTOUT_SIDE}>>>
    """

# Statistics compared with and without a team-mate.
IMPACT_STATISTICS = [
    "assists",
    "goals",
    "points",
    "shots",
    "hits",
    "powerPlayGoals",
    "powerPlayAssists",
    "penaltyMinutes",
    "faceoffTaken",
    "faceOffWins",
    "takeaways",
    "giveaways",
    "plusMinus",
    "evenTimeOnIce",
    "powerPlayTimeOnIce",
    "shortHandedTimeOnIce",
    "standings_points",
]
