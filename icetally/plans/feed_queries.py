"""Queries on payload parsing, id selection and writers.

Payloads are written by Spark from the rows of the test tables and parsed again by the operators;
the checking SQL reads the same rows directly.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import cards, feeds
from ..schemas import GOALIE_BOX, GOALIE_STATS, LIVE_FEED, SKATER_BOX, SKATER_STATS
from ..sources import readers, sinks
from . import adapters as a

# ---- box scores -----------------------------------------------------------------------------


def box_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box score per order: per side two forwards, one defenseman and one goalie."""

    def person(offset: int, position: str) -> str:
        number = f"(o_orderkey * 10 + {offset})"
        return f"""'playerId', {number}, 'sweaterNumber', {number} % 99,
          'name', map('default', 'A. P' || cast({number} as string)), 'position', '{position}'"""

    def skater(offset: int, position: str) -> str:
        return f"""named_struct({person(offset, position)}, 'goals', o_custkey % 3,
          'plusMinus', if(o_custkey % 4 = 0, null, o_custkey % 5 - 2), 'faceoffWinningPctg', 0.5,
          'toi', '12:' || lpad(cast(o_custkey % 60 as string), 2, '0'))"""

    def side(first: int) -> str:
        return f"""named_struct(
          'forwards', array({skater(first, "C")}, {skater(first + 1, "L")}),
          'defense', array({skater(first + 2, "D")}),
          'goalies', array(named_struct({person(first + 3, "G")}, 'toi', '60:00',
            'saveShotsAgainst', if(o_custkey % 2 = 0, '20/22', null))))"""

    payload = f"""to_json(named_struct('id', o_orderkey, 'season', year(o_orderdate),
      'gameType', 2, 'gameDate', cast(cast(o_orderdate as date) as string), 'venue', o_orderpriority,
      'gameScheduleState', o_orderstatus, 'period', 3,
      'gameOutcome', named_struct('lastPeriodType', if(o_custkey % 3 = 0, 'OT', 'REG')),
      'awayTeam', named_struct('id', o_custkey % 30, 'abbrev', 'A' || cast(o_custkey % 30 as string)),
      'homeTeam', named_struct('id', o_custkey % 31, 'abbrev', 'H' || cast(o_custkey % 31 as string)),
      'boxscore', named_struct('playerByGameStats',
        named_struct('awayTeam', {side(0)}, 'homeTeam', {side(4)}))))"""
    return a.view(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.expr(payload).alias("payload")
    )


def box_skaters(spark: SparkSession, sf_dir: str) -> DataFrame:
    forwards, defense, _ = feeds.box_score_tables(box_payloads(spark, sf_dir))
    rows = forwards.unionByName(defense)
    return rows.withColumn("name", F.try_element_at("name", F.lit("default")))


BOX_PLAYERS = """box as (
  select *, o_orderkey * 10 + k as playerId, case when k < 4 then 'A' || cast(o_custkey % 30 as varchar)
    else 'H' || cast(o_custkey % 31 as varchar) end as side,
    case k % 4 when 0 then 'C' when 1 then 'L' when 2 then 'D' else 'G' end as position
  from orders, lateral (select unnest(range(0, 8)) as k) x)"""
def _all_columns(fields, known: dict[str, str]) -> str:
    """Every field of a schema in SQL: its value if the payloads have it, else a null of its type."""
    kinds = {"bigint": "bigint", "double": "double"}
    return ", ".join(
        f"{known.get(f.name, f'cast(null as {kinds.get(f.dataType.simpleString(), NOTHING_TYPE)})')} as {f.name}"
        for f in fields
    )


NOTHING_TYPE = "varchar"
BOX_NAME = "'A. P' || cast(playerId as varchar)"
SKATER_VALUES = {
    "playerId": "playerId", "sweaterNumber": "playerId % 99", "name": BOX_NAME, "position": "position",
    "goals": "o_custkey % 3", "faceoffWinningPctg": "0.5::double",
    "plusMinus": "case when o_custkey % 4 = 0 then null else o_custkey % 5 - 2 end",
    "toi": "'12:' || lpad(cast(o_custkey % 60 as varchar), 2, '0')",
}
BOX_SKATERS_SQL = f"""with {BOX_PLAYERS}
select o_orderkey as game_id, side, {_all_columns(SKATER_BOX, SKATER_VALUES)} from box where position <> 'G'"""


def box_goalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    goalies = feeds.box_score_tables(box_payloads(spark, sf_dir))[2]
    keys = F.array_join(F.array_sort(F.map_keys("attributes")), ",").alias("keys")
    named = goalies.withColumn("name", F.try_element_at("name", F.lit("default")))
    return named.select("*", keys).drop("attributes")


GOALIE_VALUES = {
    "playerId": "playerId", "sweaterNumber": "playerId % 99", "name": BOX_NAME, "position": "position",
    "saveShotsAgainst": "case when o_custkey % 2 = 0 then '20/22' end", "toi": "'60:00'",
}
BOX_GOALIES_SQL = f"""with {BOX_PLAYERS}
select o_orderkey as game_id, side, {_all_columns(GOALIE_BOX, GOALIE_VALUES)},
  case when o_custkey % 2 = 0 then 'name,playerId,position,saveShotsAgainst,sweaterNumber,toi'
    else 'name,playerId,position,sweaterNumber,toi' end as keys
from box where position = 'G'"""


def discovered_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys found in the goalie entries with their frequency and type, from payloads parsed as
    variants."""
    return feeds.discovered_types(feeds.variant_entries(box_payloads(spark, sf_dir), "goalies"))


DISCOVERED_TYPES_SQL = f"""with {BOX_PLAYERS}, g as (select * from box where position = 'G')
select t.key, (select count(*) from g) as count, t.type from (values ('name', 'OBJECT<default: STRING>'),
  ('playerId', 'BIGINT'), ('position', 'STRING'), ('sweaterNumber', 'BIGINT'), ('toi', 'STRING')) t(key, type)
union all select 'saveShotsAgainst', count(*), 'STRING' from g where o_custkey % 2 = 0"""


def discovered_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys found in the goalie entries, with their frequency."""
    goalies = feeds.box_score_tables(box_payloads(spark, sf_dir))[2]
    return feeds.discovered_keys(goalies)


DISCOVERED_SQL = f"""with {BOX_PLAYERS}, g as (select * from box where position = 'G')
select unnest(['name', 'playerId', 'position', 'sweaterNumber', 'toi']) as key,
  (select count(*) from g) as count
union all select 'saveShotsAgainst', count(*) from g where o_custkey % 2 = 0"""


def game_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.game_header(box_payloads(spark, sf_dir))


GAME_HEADER_SQL = """
select o_orderkey as game_id, cast(year(o_orderdate) as varchar) as game_season, '2' as game_type,
  cast(cast(o_orderdate as date) as varchar) as game_date, o_orderpriority as game_venue,
  cast(null as varchar) as game_start_time_utc, cast(null as varchar) as game_eastern_utc_offset,
  cast(null as varchar) as game_venue_utc_offset, o_orderstatus as game_schedule_state,
  '3' as game_period, case when o_custkey % 3 = 0 then 'OT' else 'REG' end as game_last_period_type
from orders"""


def game_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.game_teams(box_payloads(spark, sf_dir))
    return feeds.widen(rows, ["id", "abbrev"])


GAME_TEAMS_SQL = """
select cast(o_orderkey as varchar) as game_id, 'away' as game_team_side,
  'A' || cast(o_custkey % 30 as varchar) as abbrev, cast(o_custkey % 30 as varchar) as id from orders
union all
select cast(o_orderkey as varchar), 'home', 'H' || cast(o_custkey % 31 as varchar),
  cast(o_custkey % 31 as varchar) from orders"""

# ---- live feeds -----------------------------------------------------------------------------

def feed_payloads(spark: SparkSession, sf_dir: str, all_final: bool = True) -> DataFrame:
    """One live feed per order; unless ``all_final``, some are unfinished or without data."""
    games = a.run(spark, sf_dir, a.gameinfo_sql(a.SPARK), "orders")
    orders = a.view(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", "o_custkey", f"{a.GAME_PK} as game_pk"
    )
    rows = orders.join(games, "game_pk")

    number = "(o_orderkey * 10 + k)"
    position = "if(k % 2 = 1, 'G', 'C')"
    info = f"""named_struct('id', {number}, 'fullName', 'Player ' || cast({number} as string),
      'active', o_custkey % 2 = 0, 'rosterStatus', 'Y', 'currentTeam', named_struct('id', k),
      'primaryPosition', named_struct('code', {position}))"""
    skater = """if(k % 2 = 1, null, named_struct('goals', o_custkey % 4, 'assists', o_custkey % 3,
      'evenTimeOnIce', '12:07', 'faceOffPct', if(o_custkey % 5 = 0, null, 52.5)))"""
    goalie = """if(k % 2 = 0, null, named_struct('timeOnIce', '59:30', 'saves', o_custkey % 30,
      'decision', if(o_custkey % 2 = 0, 'W', 'L')))"""
    boxed = f"""named_struct('person', named_struct('id', {number}, 'fullName',
        'Player ' || cast({number} as string), 'rosterStatus', 'Y'),
      'jerseyNumber', if({number} % 7 = 0, null, cast({number} % 99 as string)),
      'position', named_struct('code', {position}, 'name', if(k % 2 = 1, 'Goalie', 'Center')),
      'stats', named_struct('skaterStats', {skater}, 'goalieStats', {goalie}))"""

    def by_key(value: str, first: int, last: int) -> str:
        # Listed, not transformed: a lambda's structures are built field by field without compiled code.
        entry = f"'ID' || cast({number} as string), {value}"
        return f"map({', '.join(re.sub(r'\bk\b', str(k), entry) for k in range(first, last + 1))})"

    def side(name: str, first: int, last: int) -> str:
        return f"""named_struct('teamStats', named_struct('teamSkaterStats',
            named_struct('goals', {name}_goals, 'shots', o_custkey % 40, 'hits', o_custkey % 20)),
          'players', {by_key(boxed, first, last)},
          'coaches', array(named_struct('person', named_struct('fullName', head_coach_{name}),
              'position', named_struct('code', if(o_custkey % 10 = 0, 'AC', 'HC')))))"""

    def period(kind: str, n: int, prefix: str) -> str:
        sides = ", ".join(
            f"'{s}', named_struct('goals', {prefix}_{s}_goals, 'shotsOnGoal', o_custkey % {7 + n},"
            f" 'rinkSide', '{'left' if s == 'home' else 'right'}')"
            for s in feeds.SIDES
        )
        return f"named_struct('periodType', '{kind}', 'num', {n}, {sides})"

    regulation = ", ".join(period("REGULAR", n, f"p{n}") for n in (1, 2, 3))
    officials = """transform(sequence(0, 1 + o_custkey % 2), i -> named_struct('official', named_struct(
        'id', o_custkey * 10 + i, 'fullName', 'Official ' || cast(i as string),
        'officialType', if(i = 0, 'Referee', 'Linesman'))))"""
    plays = """transform(sequence(0, o_custkey % 3), i -> named_struct('result', named_struct(
        'event', 'Shot', 'eventTypeId', 'SHOT'), 'about', named_struct('eventIdx', i,
        'period', 1 + i, 'periodTime', '0' || cast(i as string) || ':30'),
        'coordinates', named_struct('x', o_custkey % 90, 'y', if(i = 0, null, -i))))"""
    state = (
        "'Final'"
        if all_final
        else "case o_orderstatus when 'O' then 'In Progress' else 'Final' end"
    )
    message = "1" if all_final else "case o_orderstatus when 'P' then 2 when 'F' then 1 end"
    payload = f"""named_struct('messageNumber', {message},
      'gameData', named_struct(
        'game', named_struct('pk', game_pk, 'season', season, 'type', game_type),
        'datetime', named_struct('dateTime', game_start),
        'status', named_struct('detailedState', {state}, 'startTimeTBD', o_custkey % 2 = 1),
        'teams', named_struct('away', named_struct('id', o_custkey % 30, 'name', team_away_name),
          'home', named_struct('id', o_custkey % 31, 'name', team_home_name)),
        'players', {by_key(info, 0, 3)},
        'venue', named_struct('id', if(o_custkey % 8 = 0, null, o_custkey % 40), 'name', name)),
      'liveData', named_struct(
        'decisions', named_struct('winner', named_struct('id', winning_goaltender_id),
          'firstStar', named_struct('id', first_star_id)),
        'boxscore', named_struct('teams', named_struct('away', {side("away", 0, 1)},
          'home', {side("home", 2, 3)}), 'officials', {officials}),
        'plays', named_struct('allPlays', {plays}),
        'linescore', named_struct(
          'periods', if(o_custkey % 4 = 0, array({regulation}, {period("OVERTIME", 4, "ot4")}),
            array({regulation})),
          'shootoutInfo', named_struct('away', named_struct('attempts', 3, 'scores', so_goals_away),
            'home', named_struct('attempts', 3, 'scores', so_goals_home)))))"""
    return rows.select(
        F.col("o_orderkey").cast("string").alias("id"), F.expr(f"to_json({payload})").alias("payload")
    )


def complete_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = feed_payloads(spark, sf_dir, all_final=False)
    return feeds.complete_feeds(payloads, ["gameData.status"]).select(
        "id", F.col("doc.gameData.status.detailedState").alias("game_state")
    )


def _finished(spark: SparkSession, sf_dir: str, *paths: str) -> DataFrame:
    """Parsed feeds, all of finished games, or what lies at ``paths`` of them."""
    return feeds.parse(feed_payloads(spark, sf_dir), LIVE_FEED, paths)


def game_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.game_info(_finished(spark, sf_dir))


GAMES = f"""with games as (select o_custkey, o_orderkey, g.* from orders
  join ({a.gameinfo_sql(a.DUCK)}) g on g.game_pk = {a.GAME_PK})"""
NOTHING = "cast(null as varchar)"
def periods_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.period_stats(_finished(spark, sf_dir, "gameData.game", "liveData.linescore"))


def _period_values() -> dict[str, str]:
    columns = {}
    for n, prefix in [(1, "p1"), (2, "p2"), (3, "p3"), (4, "ot4")]:
        for side in feeds.SIDES:
            values = {
                "goals": f"{prefix}_{side}_goals",
                "shots": f"cast(o_custkey % {7 + n} as varchar)",
                "rink_side": "'left'" if side == "home" else "'right'",
            }
            for name, value in values.items():
                columns[f"{prefix}_{side}_{name}"] = (
                    f"case when o_custkey % 4 = 0 then {value} end" if n == 4 else value
                )
    for side in feeds.SIDES:
        columns |= {f"so_attempts_{side}": "'3'", f"so_goals_{side}": f"so_goals_{side}"}
    return columns


def _periods_sql() -> str:
    return f"{GAMES} select game_pk, {', '.join(f'{v} as {c}' for c, v in _period_values().items())} from games"


def _game_info_sql() -> str:
    """All columns; those that the payloads don't have are null."""
    values = dict.fromkeys(["game_end"], NOTHING)
    values |= {c: c for c in ("game_pk", "season", "game_type", "game_start", "name")}
    values["game_state"] = "'Final'"
    values["game_time_tbd"] = "case when o_custkey % 2 = 1 then 'True' else 'False' end"
    values["arena_id"] = "case when o_custkey % 8 = 0 then '-999' else cast(o_custkey % 40 as varchar) end"
    for side, teams in (("away", 30), ("home", 31)):
        values[f"team_{side}_id"] = f"cast(o_custkey % {teams} as varchar)"
        values |= {f"team_{side}_name": f"team_{side}_name", f"team_{side}_shortname": NOTHING}
        values |= {f"{side}_{stat}": NOTHING for stat in feeds.TEAM_STAT_NAMES}
        values[f"{side}_goals"] = f"{side}_goals"
        values[f"{side}_shots"] = "cast(o_custkey % 40 as varchar)"
        values[f"{side}_hits"] = "cast(o_custkey % 20 as varchar)"
        values[f"head_coach_{side}"] = f"case when o_custkey % 10 = 0 then null else head_coach_{side} end"
        values[f"overtime_{side}_goals"] = (
            f"case when o_custkey % 4 = 0 then coalesce(try_cast(ot4_{side}_goals as int), 0) end"
        )
    for who in feeds.DECISIONS:
        values |= {f"{who}_id": NOTHING, f"{who}_name": NOTHING}
    values |= {f"{who}_id": f"{who}_id" for who in ("winning_goaltender", "first_star")}
    values |= _period_values()
    return f"{GAMES} select {', '.join(f'{v} as {c}' for c, v in values.items())} from games"


def player_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.player_info(_finished(spark, sf_dir, "gameData.players"))


FOUR = "orders, lateral (select unnest(range(0, 4)) as k) x"
PLAYER_VALUES = dict.fromkeys(feeds.PLAYER_INFO, NOTHING) | {
    "player_id_num": "cast(o_orderkey * 10 + k as varchar)",
    "fullName": "'Player ' || cast(o_orderkey * 10 + k as varchar)",
    "active": "case when o_custkey % 2 = 0 then 'True' else 'False' end", "rosterStatus": "'Y'",
    "currentTeamId": "cast(k as varchar)", "primaryPositionCode": "case when k % 2 = 1 then 'G' else 'C' end",
}
PLAYER_INFO_SQL = f"""
select 'ID' || cast(o_orderkey * 10 + k as varchar) as player_id,
  {", ".join(f"{v} as {c}" for c, v in PLAYER_VALUES.items())},
  cast(o_orderkey as varchar) || 'ID' || cast(o_orderkey * 10 + k as varchar) as index_val
from {FOUR}"""


def player_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.player_stats(_finished(spark, sf_dir, *[f"liveData.boxscore.teams.{side}.players" for side in feeds.SIDES]))


def _player_stats_sql() -> str:
    skater = {
        "goals": "cast(o_custkey % 4 as varchar)",
        "assists": "cast(o_custkey % 3 as varchar)",
        "evenTimeOnIce": "'12:07'",
        "faceOffPct": "case when o_custkey % 5 = 0 then null else '52.5' end",
    }
    goalie = {
        "timeOnIce": "'59:30'",
        "saves": "cast(o_custkey % 30 as varchar)",
        "decision": "case when o_custkey % 2 = 0 then 'W' else 'L' end",
    }
    columns = [
        f"case when k % 2 = 0 then {skater.get(c, NOTHING)} end as {c}" for c in SKATER_STATS
    ] + [f"case when k % 2 = 1 then {goalie.get(c, NOTHING)} end as gt_{c}" for c in GOALIE_STATS]
    number = "o_orderkey * 10 + k"
    return f"""select case when k < 2 then 'away' else 'home' end as player_teamtype,
      cast({number} as varchar) as player_id, 'Player ' || cast({number} as varchar)
        as player_fullname, {NOTHING} as player_handed, 'Y' as player_rosterStatus,
      case when ({number}) % 7 = 0 then null else cast(({number}) % 99 as varchar) end
        as player_jersey_number,
      case when k % 2 = 1 then 'G' else 'C' end as player_poscode,
      case when k % 2 = 1 then 'Goalie' else 'Center' end as player_position,
      {NOTHING} as player_postype, {NOTHING} as player_posabbrev, {", ".join(columns)},
      cast(o_orderkey as varchar) || 'ID' || cast({number} as varchar) as index_val
      from {FOUR}"""


def officials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.officials(_finished(spark, sf_dir, "liveData.boxscore.officials"))


OFFICIALS_SQL = """
select cast(o_orderkey as varchar) as game_id, cast(o_custkey * 10 + i as varchar) as official_id,
  'Official ' || cast(i as varchar) as official_name,
  case when i = 0 then 'Referee' else 'Linesman' end as official_type
from orders, lateral (select unnest(range(0, 2 + o_custkey % 2)) as i) x"""


def array_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.feed_plays(_finished(spark, sf_dir, "liveData.plays"))


NO_PLAY_VALUES = ["description", "eventId", "periodType", "ordinalNum", "periodTimeRemaining", "dateTime", "goals"]
ARRAY_ROWS_SQL = f"""
select cast(o_orderkey as varchar) as game_id, cast(i as int) as place, 'Shot' as event,
  {NOTHING} as eventCode, 'SHOT' as eventTypeId, cast(i as varchar) as eventIdx,
  {", ".join(f"{NOTHING} as {c}" for c in NO_PLAY_VALUES)},
  cast(1 + i as varchar) as period, '0' || cast(i as varchar) || ':30' as periodTime,
  cast(o_custkey % 90 as varchar) as x, case when i = 0 then null else cast(-i as varchar) end as y,
  cast(o_orderkey as varchar) || '_' || cast(i as varchar) as index_val
from orders, lateral (select unnest(range(0, 1 + o_custkey % 3)) as i) x"""


def team_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per supplier, of one team."""
    payload = """to_json(named_struct('teams', array(named_struct('id', s_suppkey, 'name', s_name,
      'venue', named_struct('name', 'Arena', 'city', cast(s_nationkey as string)),
      'abbreviation', 'S' || cast(s_suppkey as string), 'firstYearOfPlay', '1967',
      'division', named_struct('id', s_nationkey % 4, 'name', 'D'),
      'franchiseId', if(s_nationkey % 5 = 0, null, s_nationkey)))))"""
    payloads = a.view(spark, sf_dir, "supplier").selectExpr(f"{payload} as payload")
    return feeds.teams(payloads)


TEAMS_SQL = f"""
select s_suppkey as team_id, s_name as name, 'Arena' as venue, cast(s_nationkey as varchar) as city,
  'S' || cast(s_suppkey as varchar) as abbreviation, {NOTHING} as teamName, {NOTHING} as location,
  '1967' as firstSeason, cast(s_nationkey % 4 as bigint) as division_id, 'D' as division_name,
  cast(null as bigint) as conference_id, {NOTHING} as conference_name, {NOTHING} as shortName,
  case when s_nationkey % 5 = 0 then null else cast(s_nationkey as bigint) end as franchiseId,
  '1967' as firstYearOfPlay
from supplier"""


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    return a.view(spark, sf_dir, "events").select(
        "event_id",
        readers.json_path(props, "k").try_cast("bigint").alias("k"),
        readers.json_path(props, "a", "b").alias("missing"),
    )


JSON_PATHS_SQL = f"""
select event_id, cast(json_extract_string(props, '$.k') as bigint) as k,
  json_extract_string(props, '$.a.b') as missing from events"""


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads cut off in the middle are set aside; the others are read."""
    rows = a.view(spark, sf_dir, "events").select(
        "event_id",
        F.expr("if(event_type = 'error', left(props, length(props) - 3), props)").alias("payload"),
    )
    parsed = rows.withColumn("doc", F.from_json("payload", "k int"))
    passed, rejected = readers.quarantine(parsed, F.col("doc.k").isNotNull())
    return passed.select("event_id", F.lit("ok").alias("state"), F.col("doc.k").alias("k")).unionByName(
        rejected.select("event_id", F.lit("rejected").alias("state")), allowMissingColumns=True
    )


QUARANTINE_SQL = """
select event_id, case when event_type = 'error' then 'rejected' else 'ok' end as state,
  case when event_type = 'error' then null else cast(json_extract_string(props, '$.k') as int) end as k
from events"""


def feed_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed per order; of seven, one is cut off, one mistyped, and one names two head coaches."""
    coach = "named_struct('person', named_struct('fullName', o_orderpriority), 'position', named_struct('code', 'HC'))"
    document = f"""to_json(named_struct(
      'gameData', named_struct('game', named_struct('pk', o_orderkey)),
      'liveData', named_struct('boxscore', named_struct('teams', named_struct('home',
        named_struct('coaches', if(o_orderkey % 7 = 2, array({coach}, {coach}), array({coach}))))))))"""
    payload = f"""case o_orderkey % 7 when 0 then left({document}, 40)
      when 1 then '{{"gameData": 7}}' else {document} end"""
    rows = a.view(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as id", f"{payload} as payload"
    )
    readable, rejected = feeds.readable_feeds(rows)
    return readable.select("id", F.lit("ok").alias("state")).unionByName(
        rejected.select("id", F.lit("rejected").alias("state"))
    )


FEED_QUARANTINE_SQL = """
select cast(o_orderkey as varchar) as id,
  case when o_orderkey % 7 in (0, 1, 2) then 'rejected' else 'ok' end as state from orders"""

# ---- cards ----------------------------------------------------------------------------------


def card_pages(spark: SparkSession, sf_dir: str, position: str, header_by: str) -> DataFrame:
    """One card page per part; every part of size 1 gives a page that is not a card."""
    marker = f'{header_by}="player_header"'
    bio = (
        '<table id="player_bio_table"><tr><td class="bio_title">BRAND</td><td class="bio_result">\''
        " || p_brand || '</td></tr><tr><td class=\"bio_title\">Type</td><td class=\"bio_result\">'"
        " || p_type || '</td></tr></table>"
    )
    price = "cast(cast(round(p_retailprice) as bigint) as string)"
    if position == "goalie":
        stats = (
            "<div id=\"player_bio_stats\"><tr><td>Size</td><td class=\"stat\">' || cast(p_size as string)"
            f" || '</td></tr><tr><td>Price</td><td class=\"stat\">' || {price} || '</td></tr></div>"
        )
    else:
        stats = (
            "<table><tr class=\"stat_row\"><td id=\"size\">' || cast(p_size as string)"
            f" || '</td><td id=\"price\">' || {price} || '</td></tr></table>"
        )
    html = f"""case when p_size = 1 then '<html>not found</html>' else
      '<html><div {marker}>' || p_name || '</div>{bio}{stats}</html>' end"""
    return a.view(spark, sf_dir, "part").selectExpr("p_partkey as id", f"{html} as html")


def page_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four kinds of card page; attributes as rows, and pages that are no cards."""
    parts = []
    for gameyear in ("E20", "E23"):
        for position in ("skater", "goalie"):
            header_by = "class" if gameyear == "E23" else "id"
            pages = card_pages(spark, sf_dir, position, header_by)
            rows = cards.edition_cards(pages, gameyear, position)
            listed = rows.select("*", F.explode_outer("attributes").alias("attribute", "value"))
            parts.append(listed.drop("attributes").withColumn("kind", F.lit(position)))
    return feeds.align_by_name(parts)


def _attributes_sql() -> str:
    parts = []
    for gameyear in ("E20", "E23"):
        for position, size, price in (("skater", "size", "price"), ("goalie", "Size", "Price")):
            attributes = {
                "brand": "lower(p_brand)",
                "type": "lower(p_type)",
                size: "cast(p_size as varchar)",
                price: "cast(cast(round(p_retailprice) as bigint) as varchar)",
            }
            for name, value in attributes.items():
                parts.append(f"""select p_partkey as player_id, p_name as player_full_name,
                  split_part(p_name, ' ', 1) as player_first_name,
                  regexp_replace(p_name, '^[^ ]* ?', '') as player_last_name,
                  '{gameyear}' as gameyear, '{name}' as attribute, {value} as value,
                  '{position}' as kind from part where p_size <> 1""")
            parts.append(f"""select p_partkey, null, null, null, '{gameyear}', null, null, '{position}'
              from part where p_size = 1""")
    return " union all ".join(parts)


# ---- ids, increments and batches ------------------------------------------------------------


def id_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season and playoff ids of every order year, with as many season games as priorities."""
    orders = a.view(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_custkey")
    years = orders.groupBy("year").agg(F.countDistinct(F.col("o_custkey") % 40).alias("games"))
    seasons = years.withColumn("season_type", F.lit(readers.SEASON_TYPES["R"]))
    regular = readers.season_ids(seasons).select("game_id")
    return regular.unionByName(readers.playoff_ids(years).select("game_id"))


ID_RANGES_SQL = """
with years as (select year(o_orderdate) as year, count(distinct o_custkey % 40) as games
  from orders group by 1)
select cast(year as varchar) || '02' || lpad(cast(n as varchar), 4, '0') as game_id
from years, lateral (select unnest(range(1, games + 1)) as n) x
union all
select cast(year as varchar) || '030' || cast(r as varchar) || cast(m as varchar) || cast(g as varchar)
from years, (values (1, 8), (2, 4), (3, 2), (4, 1)) rounds(r, n),
  lateral (select unnest(range(0, n)) as m) y, lateral (select unnest(range(0, 7)) as g) z"""


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = a.run(spark, sf_dir, a.gameinfo_sql(a.SPARK), "orders")
    return games.select("game_pk", "season", "game_type", "game_start")


def high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.high_water_marks(_games(spark, sf_dir))


HIGH_WATER_SQL = f"""
select season, game_type, count(game_pk) as games, min(game_pk) as first_pk, max(game_pk) as last_pk
from ({a.gameinfo_sql(a.DUCK)}) g group by season, game_type"""


def incremental_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games past the stored mark, where the games up to the middle of each year are stored; the
    last stored game arrives again and is not taken twice."""
    games = _games(spark, sf_dir)
    early = F.substring("game_start", 6, 5) < "07-01"
    stored = games.where(early)
    marks = readers.high_water_marks(stored)
    arrived = games.unionByName(stored)
    return readers.incremental_rows(readers.after_mark(arrived, marks), stored)


INCREMENTAL_SQL = f"""
with games as (select game_pk, season, game_type, game_start from ({a.gameinfo_sql(a.DUCK)}) g),
stored as (select * from games where substring(game_start, 6, 5) < '07-01'),
marks as (select season, game_type, max(game_pk) as last_pk from stored group by all)
select distinct g.* from games g left join marks m using (season, game_type)
where (last_pk is null or game_pk > last_pk) and game_pk not in (select game_pk from stored)"""


def season_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``incremental_rows``, for one season and type and a stored table with season folders: the
    season's games up to the middle of its first year are stored, and all of its games arrive."""
    root = scratch(spark)
    games = _games(spark, sf_dir)
    sinks.write_seasons(games.where(F.substring("game_start", 6, 5) < "07-01"), f"{root}/gameinfo", "game_pk")
    stored = readers.read_table(spark, f"{root}/gameinfo")
    arrived = games.where(F.col("season").startswith("1995") & (F.col("game_type") == "R"))
    arrived = arrived.withColumn(readers.SEASON_FOLDER, readers.season_of(F.col("game_pk")))
    mark = readers.high_water_mark(stored, "1995", "R")
    past = readers.after_last(arrived, mark, "game_pk")
    return readers.incremental_rows(past, stored).drop(readers.SEASON_FOLDER)


SEASON_INCREMENT_SQL = f"""
with games as (select game_pk, season, game_type, game_start from ({a.gameinfo_sql(a.DUCK)}) g
  where left(season, 4) = '1995' and game_type = 'R'),
stored as (select * from games where substring(game_start, 6, 5) < '07-01')
select distinct * from games
where game_pk > coalesce((select max(game_pk) from stored), '') and game_pk not in (select game_pk from stored)"""


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = a.view(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    return readers.batches(ids, 100, block_width=64)


BATCHES_SQL = """
select page_id as id, cast((row_number() over (order by page_id) - 1) // 100 as int) as batch from pages"""


def card_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the first three batches of 50 cards, and of the rest, which a later run takes."""
    ids = a.view(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    first, later = readers.first_batches(readers.batches(ids, 50, block_width=32, fan=8), 3)
    return first.withColumn("run", F.lit("now")).unionByName(later.withColumn("run", F.lit("later")))


CARD_BATCHES_SQL = """
select id, batch, case when batch < 3 then 'now' else 'later' end as run from (
  select p_partkey as id, cast((row_number() over (order by p_partkey) - 1) // 50 as int) as batch from part)"""


# ---- writers --------------------------------------------------------------------------------


def bucket_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.with_bucket(a.view(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return rows.groupBy("hashmod").agg(F.count(F.lit(1)).alias("rows"))


def _murmur_bucket_sql(key: str, buckets: int, source: str) -> str:
    """The bucket of a long by 32-bit Murmur3 with seed 42, in whole-number arithmetic, one
    projection for each step. Fixed values: the constants of the published hash."""
    low = 4294967295

    def times(x: str, constant: int) -> str:
        return f"(({x})::hugeint * {constant} & {low})::bigint"

    def turn(x: str, bits: int) -> str:
        return f"((({x} << {bits}) & {low}) | ({x} >> {32 - bits}))"

    steps = [("k", f"{key} & {low}"), ("h", "42::bigint")]
    for word in (f"({key} >> 32) & {low}", None):
        steps += [
            ("k", times("k", 0xCC9E2D51)), ("k", turn("k", 15)), ("k", times("k", 0x1B873593)),
            ("h", "xor(h, k)"), ("h", turn("h", 13)), ("h", f"(h * 5 + {0xE6546B64}) & {low}"),
        ]
        if word:
            steps.append(("k", word))
    steps += [
        ("h", "xor(h, 8)"), ("h", "xor(h, h >> 16)"), ("h", times("h", 0x85EBCA6B)),
        ("h", "xor(h, h >> 13)"), ("h", times("h", 0xC2B2AE35)), ("h", "xor(h, h >> 16)"),
        ("h", f"case when h > {2**31 - 1} then h - {2**32} else h end"),
    ]
    sql = f"select {key}, 0::bigint as k, 0::bigint as h from {source}"
    for name, value in steps:
        sql = f"select {key}, {', '.join(f'{value} as {n}' if n == name else n for n in ('k', 'h'))} from ({sql})"
    return f"select {key}, cast((h % {buckets} + {buckets}) % {buckets} as int) as hashmod from ({sql})"


BUCKET_SIZES_SQL = f"""
select hashmod, count(*) as rows from ({_murmur_bucket_sql("o_orderkey", sinks.BUCKETS, "orders")}) group by hashmod"""


def bucket_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of the buckets that hold for any good hash: all are used, and no key has two."""
    rows = sinks.with_bucket(a.view(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    by_key = rows.groupBy("o_orderkey").agg(
        F.min("hashmod").alias("low"), F.max("hashmod").alias("high"), F.count(F.lit(1)).alias("n")
    )
    return by_key.agg(
        F.countDistinct("low").alias("buckets"),
        F.min("low").alias("lowest"),
        F.max("high").alias("highest"),
        F.sum("n").alias("rows"),
        F.count_if(F.col("low") != F.col("high")).alias("split_keys"),
    )


BUCKET_CHECKS_SQL = """
select 50 as buckets, 0 as lowest, 49 as highest, count(*) as rows, 0 as split_keys from orders"""


def stringify_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.view(spark, sf_dir, "part").selectExpr(
        "p_partkey", "if(p_size % 5 = 0, null, p_size) as arena_id", "if(p_size > 40, null, p_name) as p_name"
    )
    return sinks.stringify(sinks.fill_arena(rows))


STRINGIFY_SQL = """
select cast(p_partkey as varchar) as p_partkey,
  case when p_size % 5 = 0 then '-999' else cast(p_size as varchar) end as arena_id,
  case when p_size > 40 then 'None' else p_name end as p_name from part"""


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    return f"{sinks.shared_directory(spark)}/roundtrip-{uuid.uuid4().hex}"


def roundtrip_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``orders`` and ``nation`` in every way, read them back and sum up."""
    root = scratch(spark)
    orders = a.view(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    nation = a.view(spark, sf_dir, "nation")
    sinks.write_table(orders, f"{root}/plain")
    sinks.write_balanced(orders, f"{root}/balanced")
    sinks.compact(orders, f"{root}/compacted")
    sinks.write_bucketed(orders, f"{root}/bucketed", "o_orderkey")
    nation.write.mode("overwrite").option("header", True).csv(f"{root}/raw/nation.csv")
    entries = [("plain", "parquet", "manifest/orders"), ("raw/nation.csv", "csv", "manifest/nation")]
    sinks.compact_all(spark, root, root, entries)

    def total(path: str, key: str) -> DataFrame:
        rows = readers.read_table(spark, f"{root}/{path}")
        return rows.select(
            F.lit(path).alias("target"), F.col(key).cast("bigint").alias("key")
        ).groupBy("target").agg(F.count("key").alias("n"), F.sum("key").alias("keys"))

    csv = readers.read_text_csv(spark, f"{root}/raw/nation.csv").select(
        F.lit("raw/nation.csv").alias("target"), F.col("n_nationkey").cast("bigint").alias("key")
    )
    parts = [
        total(path, "o_orderkey")
        for path in ("plain", "balanced", "compacted", "bucketed", "manifest/orders")
    ]
    parts.append(total("manifest/nation", "n_nationkey"))
    parts.append(csv.groupBy("target").agg(F.count("key").alias("n"), F.sum("key").alias("keys")))
    return feeds.align_by_name(parts)


ROUNDTRIP_SQL = """
select t.target, o.n, o.keys from
  (select count(*) as n, cast(sum(o_orderkey) as bigint) as keys from orders) o,
  (values ('plain'), ('balanced'), ('compacted'), ('bucketed'), ('manifest/orders')) t(target)
union all
select t.target, o.n, o.keys from
  (select count(*) as n, cast(sum(n_nationkey) as bigint) as keys from nation) o,
  (values ('manifest/nation'), ('raw/nation.csv')) t(target)"""

def report_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written under pair, player and range of games, as their folders read back."""
    root = scratch(spark)
    suppliers = a.view(spark, sf_dir, "supplier").select(
        F.concat(F.lit("no "), F.col("s_suppkey").cast("string")).alias("player_a"),
        F.concat(F.lit("no "), (F.col("s_suppkey") + 2).cast("string")).alias("player_b"),
        "s_nationkey", F.col("s_suppkey").cast("string").alias("first_game"),
        (F.col("s_suppkey") + F.col("s_nationkey")).cast("string").alias("last_game"),
    )
    tenures = suppliers.select("player_a", "player_b", "first_game", "last_game")
    players = F.explode(F.array("player_a", "player_b")).alias("player_last_name")
    report = suppliers.select("player_a", "player_b", players, F.col("s_nationkey").alias("value"))
    sinks.write_reports(report, tenures, root)
    # Folder names are text, whatever they look like.
    schema = f"{report.schema.simpleString()[7:-1].replace(':', ' ')}, pair string, player string, games string"
    read = spark.read.schema(schema).parquet(root)
    # A scan plans a handful of files a task, however small; a task for each costs more than reading.
    read = read.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read.select("pair", "player", "games", "player_a", "value")


REPORT_PATHS_SQL = """
with pairs as (select 'no ' || cast(s_suppkey as varchar) as player_a, 'no ' || cast(s_suppkey + 2 as varchar) as player_b,
  cast(s_suppkey as varchar) as x, cast(s_suppkey + 2 as varchar) as y, s_nationkey,
  cast(s_suppkey as varchar) || '-' || cast(s_suppkey + s_nationkey as varchar) as games from supplier)
select least(x, y) || '_' || greatest(x, y) as pair, unnest([player_a, player_b]) as player, games, player_a,
  s_nationkey as value from pairs"""

QUERIES = {
    "report_paths": (report_paths, REPORT_PATHS_SQL),
    "box_skaters": (box_skaters, BOX_SKATERS_SQL),
    "box_goalies": (box_goalies, BOX_GOALIES_SQL),
    "discovered_columns": (discovered_columns, DISCOVERED_SQL),
    "discovered_types": (discovered_types, DISCOVERED_TYPES_SQL),
    "game_header": (game_header, GAME_HEADER_SQL),
    "game_teams": (game_teams, GAME_TEAMS_SQL),
    "complete_feeds": (
        complete_feeds,
        """select cast(o_orderkey as varchar) as id, 'Final' as game_state from orders
        where o_orderstatus = 'F'""",
    ),
    "game_info": (game_info, _game_info_sql()),
    "periods_wide": (periods_wide, _periods_sql()),
    "player_info": (player_info, PLAYER_INFO_SQL),
    "player_stats": (player_stats, _player_stats_sql()),
    "officials": (officials, OFFICIALS_SQL),
    "array_rows": (array_rows, ARRAY_ROWS_SQL),
    "team_listing": (team_listing, TEAMS_SQL),
    "json_paths": (json_paths, JSON_PATHS_SQL),
    "quarantine": (quarantined, QUARANTINE_SQL),
    "page_attributes": (page_attributes, _attributes_sql()),
    "id_ranges": (id_ranges, ID_RANGES_SQL),
    "feed_quarantine": (feed_quarantine, FEED_QUARANTINE_SQL),
    "high_water_mark": (high_water_mark, HIGH_WATER_SQL),
    "incremental_rows": (incremental_rows, INCREMENTAL_SQL),
    "season_increment": (season_increment, SEASON_INCREMENT_SQL),
    "batches": (batches, BATCHES_SQL),
    "card_batches": (card_batches, CARD_BATCHES_SQL),
    "bucket_sizes": (bucket_sizes, BUCKET_SIZES_SQL),
    "bucket_checks": (bucket_checks, BUCKET_CHECKS_SQL),
    "stringify_fill": (stringify_fill, STRINGIFY_SQL),
    "roundtrip_write": (roundtrip_write, ROUNDTRIP_SQL),
}
