"""The supplied test tables in the shapes the operators expect.

Each adapter is one SQL projection that reads whole tables and is written for both engines: Spark
runs it to feed the operators, and the checking SQL starts from the same projection. Only list
functions differ, so they come from a ``Dialect``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def each(self, n: int, expression: str) -> str:
        """List of ``expression`` over i = 0 .. n-1."""
        if self.spark:
            return f"transform(sequence(0, {n - 1}), i -> {expression})"
        return f"list_transform(range(0, {n}), lambda i: {expression})"

    def flat(self, expression: str) -> str:
        return f"flatten({expression})"

    def cut(self, items: str, start: int, end: int) -> str:
        if self.spark:
            return f"slice({items}, {start}, {end - start + 1})"
        return f"list_slice({items}, {start}, {end})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def concat(self, a: str, b: str) -> str:
        return f"concat({a}, {b})" if self.spark else f"list_concat({a}, {b})"

    def rows(self, items: str, alias: str) -> str:
        """Projection item that unnests a list."""
        return f"explode({items}) as {alias}" if self.spark else f"unnest({items}) as {alias}"


SPARK, DUCK = Dialect(True), Dialect(False)

POSITION = "case i when 0 then 'C' when 1 then 'L' when 2 then 'R' when 5 then 'G' else 'D' end"


def name_of(number: str) -> str:
    """Invented last name of a sweater number, letters only."""
    return (
        f"chr(cast(65 + {number} % 26 as int)) || chr(cast(65 + {number} * 7 % 26 as int)) || 'SON'"
    )


def home_number(i: str) -> str:
    return f"(event_id * 7 + {i} * 13) % 40"


def away_number(i: str) -> str:
    return f"40 + (event_id * 11 + {i} * 17) % 40"


def plays_sql(d: Dialect) -> str:
    """``events`` as plays: game = hour, players computed from the event id, some lists missing."""
    place = "(event_id % 7)"
    base = f"""
      select event_id, event_type, value,
        cast(2024000000 + dayofyear(ts) * 100 + hour(ts) as bigint) as game_id,
        'TA' || chr(cast(65 + (day(ts) + hour(ts)) % 8 as int)) as home_team,
        'TA' || chr(cast(65 + (day(ts) + hour(ts) + 3) % 8 as int)) as away_team,
        cast(event_id as string) as index,
        cast(1 + event_id % 3 as string) as period,
        case when event_id % 5 = 0 then 'PP' else 'EV' end as status,
        cast(event_id % 20 as string) || ':' || lpad(cast(event_id * 7 % 60 as string), 2, '0')
          as time_elapsed,
        cast(19 - event_id % 20 as string) || ':' || lpad(cast(59 - event_id * 7 % 60 as string), 2, '0')
          as time,
        case event_type when 'purchase' then 'GOAL' when 'click' then 'SHOT' when 'view' then 'MISS'
          when 'error' then 'BLOCK'
          else case event_id % 6 when 0 then 'FAC' when 1 then 'HIT' when 2 then 'GIVE'
            when 3 then 'TAKE' when 4 then 'PENL' else 'STOP' end end as play_type,
        event_id % 2 = 0 as own_home,
        {home_number(place)} as home_number, {away_number(place)} as away_number,
        case when event_id % 97 = 0 then null
          else {d.each(6, f"cast({home_number('i')} as string)")} end as home_ids,
        case when event_id % 89 = 0 then null
          else {d.each(6, f"cast({away_number('i')} as string)")} end as away_ids,
        case when event_id % 97 = 0 then null
          else {d.each(6, f"{POSITION} || cast({home_number('i')} as string)")} end as home_codes,
        case when event_id % 89 = 0 then null
          else {d.each(6, f"{POSITION} || cast({away_number('i')} as string)")} end as away_codes,
        case event_id % 3 when 0 then 'Off. Zone' when 1 then 'Def. Zone' else 'Neu. Zone' end as zone,
        case event_id % 4 when 0 then 'Wrist' when 1 then 'Slap' when 2 then 'Snap' else 'Tip-In' end
          as shot_type,
        cast(event_id % 60 + 1 as string) || ' ft.' as distance
      from events"""
    return f"""
      select *, case when event_id % 53 = 0 then null when own_home then home_team else away_team end
          as shooter_team,
        case when own_home then home_team else away_team end as own_team,
        case when own_home then away_team else home_team end as other_team,
        case when own_home then home_number else away_number end as own_number,
        case when own_home then away_number else home_number end as other_number,
        {name_of("(case when own_home then home_number else away_number end)")} as own_name,
        {name_of("(case when own_home then away_number else home_number end)")} as other_name,
        {name_of("home_number")} as home_name, {name_of("away_number")} as away_name
      from ({base}) b"""


OWN = "own_team || ' #' || cast(own_number as string) || ' ' || own_name"
OTHER = "other_team || ' #' || cast(other_number as string) || ' ' || other_name"
NUMBERED = "'#' || cast(own_number as string) || ' ' || own_name"

# Text of each event code, in the formats of the play reports.
DETAILS = {
    "FAC": "own_team || ' won ' || zone || ' - ' || away_team || ' #' || cast(away_number as string)"
    " || ' ' || away_name || ' vs ' || home_team || ' #' || cast(home_number as string)"
    " || ' ' || home_name",
    "HIT": f"{OWN} || ' HIT ' || {OTHER} || ', ' || zone",
    "BLOCK": f"{OWN} || ' BLOCKED BY ' || {OTHER} || ', ' || shot_type || ', ' || zone",
    "MISS": f"{OWN} || ', ' || shot_type || case when event_id % 19 = 0 then '' else"
    " ', Wide of Net, ' || zone || ', ' || distance end",
    "GIVE": f"own_team || ' GIVEAWAY - ' || {NUMBERED} || ', ' || zone",
    "TAKE": f"own_team || ' TAKEAWAY - ' || {NUMBERED} || ', ' || zone",
    "PENL": f"case when event_id % 4 = 0 then {OWN} || ' Fighting (maj)(5 min), ' || zone else"
    f" {OWN} || ' Tripping(2 min), ' || zone || ' Drawn By: ' || {OTHER} end",
    "SHOT": f"own_team || ' ONGOAL - ' || {NUMBERED} || ', ' || shot_type || ', ' || zone"
    " || ', ' || distance",
    "GOAL": f"{OWN} || '(' || cast(event_id % 50 as string) || '), ' || shot_type || ', ' || zone"
    " || ', ' || distance || case event_id % 3 when 0 then ''"
    " when 1 then ' Assists: #' || cast(other_number as string) || ' ' || other_name || '(7)'"
    " else ' Assists: #' || cast(other_number as string) || ' ' || other_name || '(7); #'"
    " || cast(own_number as string) || ' ' || own_name || '(12)' end",
    "STOP": "'ICING'",
}


def detail_by_type() -> str:
    """Text of each play by its own code; some texts are missing."""
    cases = " ".join(f"when '{code}' then {text}" for code, text in DETAILS.items())
    return f"case when event_id % 101 = 0 then null else case play_type {cases} end end"


def tokens_sql(d: Dialect) -> str:
    """On-ice tokens of each event: usual, too few players, and an away side without goalie."""

    def tokens(number: str, position: str) -> str:
        return d.flat(d.each(6, d.array(f"cast({number} as string)", position)))

    away, home = tokens(away_number("i"), POSITION), tokens(home_number("i"), POSITION)
    skaters = tokens(away_number("i"), "'D'")
    return f"""
      select event_id, case
        when event_id % 11 = 0 then {d.cut(away, 1, 8)}
        when event_id % 13 = 0 then {d.concat(skaters, home)}
        when event_id % 17 = 0 then {d.concat(skaters, d.cut(home, 3, 12))}
        else {d.concat(away, home)} end as on_ice,
        {d.cut(away, 1, 12)} as away_tokens, {d.cut(home, 1, 12)} as home_tokens,
        {skaters} as skater_tokens
      from events"""


def box_sql(d: Dialect) -> str:
    """Skater box score: one row per game, side and player seen in ``events``."""

    def side(team: str, ids: str) -> str:
        return f"select game_id, {team} as side, {d.rows(ids, 'player')} from plays"

    return f"""
      select distinct game_id, side, cast(player as bigint) as playerid,
        case cast(player as bigint) % 5 when 0 then 'C' when 1 then 'L' when 2 then 'R' else 'D' end
          as position,
        chr(cast(65 + cast(player as bigint) % 26 as int)) || '. '
          || {name_of("cast(player as bigint)")} as full_name,
        cast((cast(player as bigint) + game_id) % 7 as bigint) - 3 as plusminus,
        case when cast(player as bigint) % 31 = 7 then '0:00' else
          cast(8 + cast(player as bigint) % 15 as string) || ':'
          || lpad(cast((game_id + cast(player as bigint)) % 60 as string), 2, '0') end as toi,
        case when cast(player as bigint) % 31 = 7 then '0:00' when cast(player as bigint) % 29 = 3
          then null else cast(cast(player as bigint) % 4 as string) || ':15' end as powerplaytoi,
        case when cast(player as bigint) % 31 = 7 then '0:00' else
          cast(cast(player as bigint) % 3 as string) || ':30' end as shorthandedtoi
      from ({side("home_team", "home_ids")} union all {side("away_team", "away_ids")}) p"""


def roster_sql(d: Dialect) -> str:
    """Roster rows of every code seen in ``events``; every ninth sweater is listed differently."""

    def side(team: str, number: str) -> str:
        row = d.each(
            6, f"cast(({number}) * 10 + case when i = 5 then 5 else least(i, 3) end as bigint)"
        )
        return f"select game_id, {team} as side, {d.rows(row, 'entry')} from plays"

    return f"""
      select distinct game_id, side,
        case entry % 10 when 0 then 'C' when 1 then 'L' when 2 then 'R' when 5 then 'G' else 'D' end
          as position,
        cast(floor(entry / 10) as bigint) + case when entry % 9 = 0 then 100 else 0 end
          as sweater,
        entry as player_id,
        chr(cast(65 + entry % 26 as int)) || '. ' || {name_of("entry")} as full_name
      from ({side("home_team", home_number("i"))} union all {side("away_team", away_number("i"))}) p"""


GAME_PK = (
    "cast(year(o_orderdate) as string) || lpad(cast(1 + o_orderkey % 3 as string), 2, '0')"
    " || lpad(cast(o_orderkey as string), 10, '0')"
)


def gameinfo_sql(d: Dialect) -> str:
    """``orders`` as the all-string game table: one game per order."""

    def goals(expression: str, unless: str = "false") -> str:
        return f"case when {unless} then 'None' else cast({expression} as string) end"

    return f"""
      select {GAME_PK} as game_pk,
        cast(year(o_orderdate) as string) || cast(year(o_orderdate) + 1 as string) as season,
        case o_orderkey % 3 when 0 then 'PR' when 1 then 'R' else 'P' end as game_type,
        cast(cast(o_orderdate as date) as string) || 'T19:00:00Z' as game_start,
        'Away ' || cast(o_custkey % 30 as string) as team_away_name,
        'Home ' || cast(o_custkey % 31 as string) as team_home_name,
        cast(o_orderkey % 100 as string) as winning_goaltender_id,
        cast(o_orderkey % 90 as string) as losing_goaltender_id,
        {goals("o_orderkey * 7 % 100", "o_orderkey % 10 = 0")} as first_star_id,
        cast(o_orderkey * 3 % 100 as string) as second_star_id,
        cast(o_orderkey * 11 % 100 as string) as third_star_id,
        'Arena ' || cast(o_custkey % 40 as string) as name,
        cast(o_orderkey % 6 as string) as away_goals, cast(o_orderkey % 5 as string) as home_goals,
        'Coach ' || cast(o_custkey % 50 as string) as head_coach_away,
        'Coach ' || cast(o_custkey % 51 as string) as head_coach_home,
        {goals("o_orderkey % 3")} as p1_away_goals, {goals("o_orderkey % 2")} as p2_away_goals,
        {goals("o_orderkey * 3 % 2")} as p3_away_goals,
        {goals("o_orderkey % 7 % 2", "o_orderkey % 3 = 1")} as ot4_away_goals,
        {goals("o_orderkey % 4", "o_orderkey % 5 < 2")} as so_goals_away,
        {goals("o_orderkey % 4")} as p1_home_goals,
        {goals("o_orderkey % 2", "o_orderkey % 9 = 0")} as p2_home_goals,
        {goals("o_orderkey % 5 % 2")} as p3_home_goals,
        {goals("o_orderkey % 5 % 2", "o_orderkey % 3 = 1")} as ot4_home_goals,
        {goals("o_orderkey % 3", "o_orderkey % 5 < 2")} as so_goals_home
      from orders"""


def playerstats_sql(d: Dialect) -> str:
    """``lineitem`` as the all-string player table: one row per order and supplier."""

    def number(expression: str) -> str:
        return f"cast(cast({expression} as bigint) as string)"

    def clock(minutes: str) -> str:
        return f"case when l_suppkey % 5 = 0 then 'None' else cast({minutes} as string) || ':30' end"

    def goalie(expression: str) -> str:
        return f"case when l_suppkey % 5 = 0 then {number(expression)} else 'None' end"

    rows = """
      select l_orderkey, l_suppkey, sum(cast(l_quantity as bigint)) as qty, count(*) as n,
        max(l_linenumber) as line
      from lineitem group by l_orderkey, l_suppkey"""
    return f"""
      select {GAME_PK} || 'ID' || cast(l_suppkey as string) as index_val,
        case when l_suppkey % 2 = 0 then 'home' else 'away' end as player_teamtype,
        cast(l_suppkey as string) as player_id,
        'Player ' || cast(l_suppkey as string) as player_fullname,
        case (l_suppkey + l_orderkey) % 10 when 0 then 'N' when 1 then 'I' else 'Y' end
          as player_rosterStatus,
        cast(l_suppkey % 99 as string) as player_jersey_number,
        case when l_suppkey % 5 = 0 then 'Goalie' else 'Center' end as player_position,
        case when l_suppkey % 3 = 0 then 'L' else 'R' end as player_handed,
        case when n > 1 then 'None' else {number("n + line % 2")} end as assists,
        {number("qty % 4")} as goals, {number("qty")} as shots, {number("line")} as hits,
        {number("qty % 3")} as powerPlayGoals, {number("line % 2")} as powerPlayAssists,
        {number("2 * (qty % 2)")} as penaltyMinutes,
        case when line = 1 then null else {number("line + 3")} end as faceoffTaken,
        case when line = 7 then 'n/a' else {number("line")} end as faceOffWins,
        {number("qty % 5")} as takeaways, {number("qty % 6")} as giveaways,
        {number("qty % 2")} as shortHandedGoals, {number("0")} as shortHandedAssists,
        {number("qty % 7")} as blocked, {number("qty % 5 - 2")} as plusMinus,
        {clock("8 + qty % 12")} as evenTimeOnIce, {clock("line")} as powerPlayTimeOnIce,
        {clock("n")} as shortHandedTimeOnIce,
        case when l_suppkey % 5 = 0 then cast(40 + line as string) || ':10' else 'None' end
          as gt_timeOnIce,
        {goalie("0")} as gt_assists, {goalie("0")} as gt_goals, {goalie("line % 2")} as gt_pim,
        {goalie("20 + qty")} as gt_shots, {goalie("18 + qty")} as gt_saves,
        {goalie("line")} as gt_powerPlaySaves, {goalie("n")} as gt_shortHandedSaves,
        {goalie("10 + qty")} as gt_evenSaves, {goalie("n + 1")} as gt_shortHandedShotsAgainst,
        {goalie("11 + qty")} as gt_evenShotsAgainst, {goalie("line + 1")} as gt_powerPlayShotsAgainst,
        case when l_suppkey % 15 = 0 then 'W' when l_suppkey % 15 = 5 then 'L' else 'None' end
          as gt_decision
      from ({rows}) s join orders o on o.o_orderkey = s.l_orderkey"""


PAIRS_SQL = """
  select 'player ' || cast(s_suppkey as string) as player_a,
    'player ' || cast(s_suppkey + 2 as string) as player_b
  from supplier"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, sql: str, *tables: str, **frames: DataFrame) -> DataFrame:
    """Run an adapter over the named test tables (and frames made from them)."""
    sources = {t: view(spark, sf_dir, t) for t in tables} | frames
    for name in sources:
        sql = _braced(sql, name)
    return spark.sql(sql, **sources)


def _braced(sql: str, name: str) -> str:
    return re.sub(rf"\b(from|join)\s+{name}\b", rf"\1 {{{name}}}", sql)
