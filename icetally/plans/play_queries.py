"""Queries on play-by-play operators, over ``events`` in the shape of plays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrays import on_ice_codes, players_on_ice, positions_of, split_on_ice
from ..functions.text import clock_seconds, elapsed_seconds
from ..operators import attempts, onice, plays as play_ops, playtext
from ..schemas import ATTEMPT_TYPES, PARSED_TYPES, SPARSE_EVENT_COLUMNS
from ..sources import readers, sinks
from ..sources.folders import new_folder
from . import adapters as a

PLAYS = f"with plays as ({a.plays_sql(a.DUCK)})"


# ---- inputs ---------------------------------------------------------------------------------


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.run(spark, sf_dir, a.plays_sql(a.SPARK), "events")


def attempt_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays as the attempt metrics read them."""
    return base(spark, sf_dir).select(
        "game_id",
        "home_team",
        "away_team",
        "status",
        F.col("play_type").alias("type"),
        "shooter_team",
        F.col("home_ids").alias("home_onice_ids"),
        F.col("away_ids").alias("away_onice_ids"),
    )


def detailed_plays(spark: SparkSession, sf_dir: str, code: str | None = None) -> DataFrame:
    """Plays with their text: each of its own code, or all written as one code."""
    text = a.detail_by_type() if code is None else a.DETAILS[code]
    kind = F.col("play_type") if code is None else F.lit(code)
    return base(spark, sf_dir).select(
        "game_id",
        "away_team",
        "home_team",
        "index",
        "period",
        "status",
        kind.alias("type"),
        F.expr(text).alias("detail"),
        "time",
        "time_elapsed",
        F.col("home_codes").alias("home_onice_code"),
        F.col("away_codes").alias("away_onice_code"),
    )


def box(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Forwards and defensemen of the skater box score."""
    rows = a.run(spark, sf_dir, a.box_sql(a.SPARK), plays=base(spark, sf_dir))
    rows = rows.withColumn("name", F.create_map(F.lit("default"), "full_name"))
    defense = F.col("position") == "D"
    return rows.where(~defense), rows.where(defense)


def toi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.skater_toi(*box(spark, sf_dir))


# ---- attempt metrics ------------------------------------------------------------------------


def on_off_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.player_attempts_by_game(attempt_plays(spark, sf_dir))


def _in(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


# Every attempt from the view of both teams, and the players seen on the ice per game and team.
SEEN = f"""{PLAYS}, seen as (
  select p.*, t.team, t.team = p.shooter_team and p.shooter_team is not null as is_for
  from (select * from plays where play_type in ({_in(ATTEMPT_TYPES)})) p,
    lateral (select unnest([p.home_team, p.away_team]) as team) t),
players as (
  select distinct game_id, team, unnest(list_concat(coalesce(home_ids, []), coalesce(away_ids, [])))
    as player_id from seen),
pairs as (
  select s.*, p.player_id,
    coalesce(list_contains(home_ids, player_id), false) or
    coalesce(list_contains(away_ids, player_id), false) as is_on,
    (not list_contains(home_ids, player_id)) and (not list_contains(away_ids, player_id)) as is_off
  from seen s join players p using (game_id, team))"""

SHARES = f"""{SEEN}, sums as (
  select game_id, team, player_id,
    count(*) filter (is_on and is_for) as corsi_for,
    count(*) filter (is_on and not is_for) as corsi_against,
    count(*) filter (is_on and is_for and play_type = 'GOAL') as goals_for,
    count(*) filter (is_on and not is_for and play_type = 'GOAL') as goals_against,
    count(*) filter (is_off and is_for) as rel_corsi_for,
    count(*) filter (is_off and not is_for) as rel_corsi_against
  from pairs group by all),
shares as (
  select *, corsi_for - corsi_against as corsi,
    corsi_for / (corsi_for + corsi_against) as corsi_for_pct,
    rel_corsi_for - rel_corsi_against as rel_corsi,
    rel_corsi_for / (rel_corsi_for + rel_corsi_against) as rel_corsi_for_pct,
    corsi_for / (corsi_for + corsi_against)
      - rel_corsi_for / (rel_corsi_for + rel_corsi_against) as corsi_for_relative_pct
  from sums where rel_corsi_for + rel_corsi_against > 0)"""

SHARE_COLUMNS = (
    "game_id, team, player_id, corsi_for, corsi_against, corsi, corsi_for_pct, goals_for,"
    " goals_against, rel_corsi_for, rel_corsi_against, rel_corsi, rel_corsi_for_pct,"
    " corsi_for_relative_pct"
)


def on_ice_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempts.with_totals(attempts.on_ice_attempts(attempt_plays(spark, sf_dir)))
    return rows.drop(*[c for c in rows.columns if c.startswith(attempts.KNOWN)])


def off_ice_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.off_ice_attempts(attempt_plays(spark, sf_dir))


def _counts_sql(flag: str) -> str:
    counts = ", ".join(
        f"count(*) filter ({flag} and {'is_for' if way == 'for' else 'not is_for'}"
        f" and play_type = '{code}') as {kind}_{way}"
        for code, kind in attempts.COUNT_NAMES.items()
        for way in attempts.DIRECTIONS
    )
    return f"""{SEEN}, c as (
      select game_id, team, player_id, {counts},
        count(*) filter ({flag} and is_for) as corsi_for,
        count(*) filter ({flag} and not is_for) as corsi_against
      from pairs group by all)
    select *, corsi_for - corsi_against as corsi,
      corsi_for / (corsi_for + corsi_against) as corsi_for_pct
    from c where corsi_for + corsi_against > 0"""


SECONDS = "(cast(split_part({c}, ':', 1) as bigint) * 60 + cast(split_part({c}, ':', 2) as bigint))"
TOI = f"""toi as (
  select game_id, playerid, side, full_name, plusminus, powerplaytoi, shorthandedtoi, toi, position,
    {SECONDS.format(c='toi')} as toi_s, {SECONDS.format(c='powerplaytoi')} as powerplaytoi_s,
    {SECONDS.format(c='shorthandedtoi')} as shorthandedtoi_s,
    {SECONDS.format(c='toi')} - {SECONDS.format(c='powerplaytoi')}
      - {SECONDS.format(c='shorthandedtoi')} as evenstrengthtoi_s
  from ({a.box_sql(a.DUCK)}) b)"""


def skater_toi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toi(spark, sf_dir)
    return rows.withColumn("name", F.try_element_at("name", F.lit("default")))


def teams_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.teams_key(toi(spark, sf_dir))


def players_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.players_key(toi(spark, sf_dir))


DETAIL = f"""{SHARES}, {TOI}, detail as (
  select s.*, t.playerid, t.side, t.full_name, t.position, t.plusminus, t.toi_s, t.evenstrengthtoi_s,
    corsi_for * (3600.0::double / nullif(evenstrengthtoi_s, 0)) as corsi_for_per_es60,
    corsi_against * (3600.0::double / nullif(evenstrengthtoi_s, 0)) as corsi_against_per_es60
  from shares s join toi t on t.game_id = s.game_id and t.side = s.team
    and cast(t.playerid as varchar) = s.player_id)"""


def game_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempts.game_detail(attempt_plays(spark, sf_dir), toi(spark, sf_dir))
    return rows.withColumn("name", F.try_element_at("name", F.lit("default"))).select(*DETAIL_COLUMNS)


DETAIL_COLUMNS = [
    *SHARE_COLUMNS.replace(" ", "").split(","), "name", "position", "plusminus", "toi_s", "evenstrengthtoi_s",
    "corsi_for_per_es60", "corsi_against_per_es60", "corsi_per_es60",
]


def participant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ice_time = toi(spark, sf_dir)
    detail = attempts.game_detail(attempt_plays(spark, sf_dir), ice_time)
    rows = attempts.team_summary(detail, ice_time)
    rounded = [*attempts.AVERAGED, "average_corsi_per_60", "toipg"]
    return rows.withColumns({c: F.round(c, 6) for c in rounded})


def bucketed_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``game_detail`` over copies of plays and ice time that are bucketed by game."""
    root = new_folder(spark, "buckets")
    tables = {"plays": attempt_plays(spark, sf_dir), "times": toi(spark, sf_dir)}
    plays, times = (
        sinks.save_bucketed(rows, f"{name}_{root.rsplit('-', 1)[1]}", f"{root}/{name}", ["game_id"], 8)
        for name, rows in tables.items()
    )
    rows = attempts.game_detail_in_place(plays, times)
    return rows.withColumn("name", F.try_element_at("name", F.lit("default"))).select(*DETAIL_COLUMNS)


def append_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary from stored sums: those of the first two thirds of the games, and, added later,
    those of the rest."""
    root = new_folder(spark, "summary")
    plays, ice_time = attempt_plays(spark, sf_dir), toi(spark, sf_dir)
    for load, games in enumerate(("game_id % 3 < 2", "game_id % 3 = 2")):
        times = ice_time.where(games)
        parts = attempts.summary_state(attempts.game_detail(plays.where(games), times), times)
        for rows, name in zip(parts, ("metrics", "usage")):
            sinks.write_table(rows, f"{root}/{name}/load={load}")
    stored = [readers.read_table(spark, f"{root}/{name}").drop("load") for name in ("metrics", "usage")]
    rows = attempts.summary_of_state(*attempts.merged_state(*stored))
    rounded = [*attempts.AVERAGED, "average_corsi_per_60", "toipg"]
    return rows.withColumns({c: F.round(c, 6) for c in rounded})


def _summary_sql() -> str:
    means = ", ".join(f"round(avg({c}), 6) as {c}" for c in attempts.AVERAGED)
    return f"""{DETAIL}, means as (
      select playerid, side, {means},
        round(avg(corsi_for_per_es60 - corsi_against_per_es60), 6) as average_corsi_per_60,
        cast(sum(plusminus) as bigint) as plusminus from detail group by all),
    listed as (
      select playerid, side, position, full_name as name, count(distinct game_id) as games_played,
        round(sum(toi_s) / count(distinct game_id), 6) as toipg from toi group by all)
    select p.* exclude (side), p.side as team, m.* exclude (playerid, side)
    from listed p left join means m on m.playerid = p.playerid and m.side = p.side"""


# ---- clocks and on-ice lists ----------------------------------------------------------------


def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select(
        "event_id",
        clock_seconds(F.col("time")).alias("time_s"),
        elapsed_seconds(F.col("period"), F.col("time_elapsed")).alias("time_elapsed_s"),
    )


CLOCKS_SQL = """
select event_id, (19 - event_id % 20) * 60 + 59 - event_id * 7 % 60 as time_s,
  cast((event_id % 3) * 1200 + (event_id % 20) * 60 + event_id * 7 % 60 as int) as time_elapsed_s
from events"""


def _token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.run(spark, sf_dir, a.tokens_sql(a.SPARK), "events")


def split_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_ice = F.col("on_ice")
    away, home = split_on_ice(on_ice)
    return _token_rows(spark, sf_dir).select(
        "event_id",
        players_on_ice(on_ice).alias("num_on_ice"),
        F.array_join(positions_of(on_ice, "D").cast("array<string>"), ",").alias("d_places"),
        F.array_join(away, ",").alias("away"),
        F.array_join(home, ",").alias("home"),
    )


def _joined(items: str) -> str:
    return f"coalesce(array_to_string({items}, ','), '')"


SPLIT_SQL = f"""
with t as ({a.tokens_sql(a.DUCK)})
select event_id, cast(len(on_ice) // 2 as int) as num_on_ice,
  {_joined("list_filter(list_transform(range(0, len(on_ice)), lambda i: case when on_ice[i + 1] = 'D' then i end), lambda x: x is not null)")} as d_places,
  case when event_id % 11 = 0 or event_id % 13 = 0 then ''
    when event_id % 17 = 0 then {_joined("skater_tokens")} else {_joined("away_tokens")} end as away,
  case when event_id % 11 = 0 or event_id % 13 = 0 then ''
    when event_id % 17 = 0 then {_joined("list_slice(home_tokens, 3, 12)")}
    else {_joined("home_tokens")} end as home
from t"""


def participant_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_rows(spark, sf_dir).select(
        "event_id", F.array_join(on_ice_codes(F.col("on_ice")), ",").alias("codes")
    )


CODES_SQL = f"""
with t as ({a.tokens_sql(a.DUCK)})
select event_id, array_to_string(list_transform(range(0, len(on_ice) // 2),
  lambda i: on_ice[2 * i + 2] || on_ice[2 * i + 1]), ',') as codes
from t"""


def _raw_for_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays with their on-ice tokens split by side; every eleventh has none."""
    rows = base(spark, sf_dir).join(_token_rows(spark, sf_dir), "event_id")
    short = F.col("event_id") % 11 == 0
    empty = F.array().cast("array<string>")
    return rows.select(
        "game_id",
        "away_team",
        "home_team",
        "index",
        "period",
        "status",
        F.col("play_type").alias("type"),
        F.lit(None).cast("string").alias("detail"),
        "time",
        "time_elapsed",
        "on_ice",
        F.lit(0).alias("time_elapsed_s"),
        F.when(short, empty).otherwise(F.col("away_tokens")).alias("away_onice_array1"),
        F.when(short, empty).otherwise(F.col("home_tokens")).alias("home_onice_array1"),
    )


def attach_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster = a.run(spark, sf_dir, a.roster_sql(a.SPARK), plays=base(spark, sf_dir)).select(
        "game_id",
        "side",
        "position",
        F.col("sweater").alias("sweaterNumber"),
        F.col("player_id").alias("playerId"),
        F.create_map(F.lit("default"), "full_name").alias("name"),
    )
    rows = onice.attach_on_ice(_raw_for_roster(spark, sf_dir), roster)
    lists = [f"{s}_onice_{n}" for s in onice.SIDES for n in onice.LISTS]
    return rows.select("game_id", "index", *[F.array_join(c, ",").alias(c) for c in lists])


def _attach_sql() -> str:
    parts = []
    for side in ("home", "away"):
        number = a.home_number("i") if side == "home" else a.away_number("i")
        listed = f"""
          select event_id, i, case i when 0 then 'C' when 1 then 'L' when 2 then 'R' when 5 then 'G'
              else 'D' end || cast({number} as varchar) as code,
            ({number}) * 10 + least(i, 3) + 2 * cast(i = 5 as int) as entry
          from events, lateral (select unnest(range(0, 6)) as i) x where event_id % 11 <> 0"""
        parts.append(f"""{side}_lists as (
          select event_id, string_agg(code, ',' order by i) as {side}_onice_code,
            string_agg({a.name_of('entry')}, ',' order by i) as {side}_onice_names,
            string_agg(cast(entry as varchar), ',' order by i) as {side}_onice_ids,
            string_agg(chr(cast(65 + entry % 26 as int)), ',' order by i) as {side}_onice_firstinit
          from ({listed}) l where entry % 9 <> 0 group by event_id)""")
    columns = ", ".join(
        f"case when event_id % 11 = 0 then '' else {s}_onice_{n} end as {s}_onice_{n}"
        for s in onice.SIDES
        for n in onice.LISTS
    )
    return f"""{PLAYS}, {", ".join(parts)}
      select game_id, index, {columns} from plays
      left join home_lists using (event_id) left join away_lists using (event_id)"""


# ---- parsers --------------------------------------------------------------------------------

OWN_SQL = a.OWN
OTHER_SQL = a.OTHER
FULL = "case when event_id % 19 = 0 then null else {} end"


def _lineup_sql(role: str, who: str) -> dict[str, str]:
    """Columns of a role taken by the acting (``own``) or the other player."""
    own = who == "own"
    at_home = "own_home" if own else "not own_home"
    place = (
        f"case when ({at_home}) then case when home_codes is null then null else coalesce("
        f"list_position(list_transform(home_codes, lambda c: c[2:]), cast({who}_number as varchar)), 0) end"
        f" else case when away_codes is null then null else coalesce("
        f"list_position(list_transform(away_codes, lambda c: c[2:]), cast({who}_number as varchar)), 0) end end"
    )
    return {
        f"{role}_team": f"{who}_team",
        f"{role}_jn": f"cast({who}_number as varchar)",
        f"{role}_lastname": f"{who}_name",
        f"home_{role}": f"({at_home})",
        f"{role}_onice_index": f"cast({place} as int)",
    }


def _taker_sql(side: str) -> str:
    return (
        f"cast(case when {side}_codes is null then null else coalesce(list_position("
        f"list_transform({side}_codes, lambda c: c[2:]), cast({side}_number as varchar)), 0) end as int)"
    )


def _only(columns: dict[str, str], condition: str) -> dict[str, str]:
    return {n: f"case when {condition} then {e} end" for n, e in columns.items()}


def _absent_lineup(columns: dict[str, str], condition: str) -> dict[str, str]:
    """A role that is only present under a condition: no team or place, and not at home."""
    out = _only(columns, condition)
    home = next(n for n in columns if n.startswith("home_"))
    out[home] = f"coalesce({columns[home]} and {condition}, false)"
    return out


def _expected() -> dict[str, dict[str, str]]:
    """Per code, the parser's columns in terms of the pieces its text was written from."""
    drawn = "event_id % 4 <> 0"
    first, second = "event_id % 3 <> 0", "event_id % 3 = 2"
    mate = "own_team || ' #' || cast(other_number as varchar) || ' ' || other_name"
    assist = _lineup_sql("primary_assist_player", "other") | {
        "primary_assist_player_team": "own_team",
        "home_primary_assist_player": "own_home",
        "primary_assist_player_onice_index": "cast(case when own_home then case when home_codes is null"
        " then null else coalesce(list_position(list_transform(home_codes, lambda c: c[2:]),"
        " cast(other_number as varchar)), 0) end else case when away_codes is null then null else"
        " coalesce(list_position(list_transform(away_codes, lambda c: c[2:]),"
        " cast(other_number as varchar)), 0) end end as int)",
    }
    return {
        "FAC": {
            "fo_winning_team": "own_team",
            "fo_zone": "zone",
            "fo_away_player": "away_team || ' #' || cast(away_number as varchar) || ' ' || away_name",
            "fo_home_player": "home_team || ' #' || cast(home_number as varchar) || ' ' || home_name",
            "away_onice_index": _taker_sql("away"),
            "home_onice_index": _taker_sql("home"),
            "winner_home": "own_home",
        },
        "HIT": {"hitter": OWN_SQL, "hittee": OTHER_SQL, "hit_location": "zone"}
        | _lineup_sql("hitter", "own")
        | _lineup_sql("hittee", "other"),
        "BLOCK": {
            "shooter": OWN_SQL,
            "blocker": OTHER_SQL,
            "shot_type": "shot_type",
            "block_location": "zone",
        }
        | _lineup_sql("shooter", "own")
        | _lineup_sql("blocker", "other"),
        "MISS": {
            "shooter": OWN_SQL,
            "shot_type": "shot_type",
            "shot_result": FULL.format("'Wide of Net'"),
            "shot_zone": FULL.format("zone"),
            "shot_distance": FULL.format("distance"),
        }
        | _lineup_sql("shooter", "own"),
        "GIVE": {"giveaway_player": OWN_SQL, "giveaway_zone": "zone"}
        | _lineup_sql("giveaway_player", "own"),
        "TAKE": {"takeaway_player": OWN_SQL, "takeaway_zone": "zone"}
        | _lineup_sql("takeaway_player", "own"),
        "PENL": {
            "penalty_committed_by": OWN_SQL,
            "penalty_drawn_by": f"case when {drawn} then {OTHER_SQL} end",
            "penalty_zone": "zone",
            "penalty_detail": f"case when {drawn} then 'Tripping' else 'Fighting' end",
            "maj_flag": f"case when {drawn} then 0 else 1 end",
            "penalty_duration": f"case when {drawn} then '2 min' else '5 min' end",
        }
        | _lineup_sql("penalty_committed_by", "own")
        | _absent_lineup(_lineup_sql("penalty_drawn_by", "other"), drawn),
        "GOAL": {
            "goal_scorer": OWN_SQL,
            "goal_scorer_shottype": "shot_type",
            "goal_scorer_shotzone": "zone",
            "goal_scorer_shotdist": "distance",
            "primary_assist_player": f"case when {first} then {mate} end",
            "secondary_assist_player": f"case when {second} then {OWN_SQL} end",
            "goal_scorer_num_goals": "cast(event_id % 50 as int)",
            "primary_assistor_num_assists": f"case when {first} then 7 end",
            "secondary_assistor_num_assists": f"case when {second} then 12 end",
        }
        | _lineup_sql("goal_scorer", "own")
        | _absent_lineup(assist, first)
        | _absent_lineup(_lineup_sql("secondary_assist_player", "own"), second),
        "SHOT": {
            "shooting_team": "own_team",
            "shooter": OWN_SQL,
            "shot_type": "shot_type",
            "shot_zone": "zone",
            "shot_distance": "distance",
        }
        | _lineup_sql("shooter", "own"),
        }


EXPECTED = _expected()


def parser_query(code: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = play_ops.parse_type(detailed_plays(spark, sf_dir, code), code)
        return rows.select("game_id", "index", *EXPECTED[code])

    return query


def parser_sql(code: str) -> str:
    columns = ", ".join(f"{e} as {n}" for n, e in EXPECTED[code].items())
    return f"{PLAYS} select game_id, index, {columns} from plays"


def lineup_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-up columns of a role text given as a column."""
    rows = base(spark, sf_dir).select(
        "event_id",
        "home_team",
        F.col("home_codes").alias("home_onice_code"),
        F.col("away_codes").alias("away_onice_code"),
        F.expr(a.OWN).alias("actor"),
    )
    return play_ops.append_lineup_info(rows, "actor").drop(
        "home_team", "home_onice_code", "away_onice_code"
    )


def _lineup_position_sql() -> str:
    columns = ", ".join(f"{e} as {n}" for n, e in _lineup_sql("actor", "own").items())
    return f"{PLAYS} select event_id, {OWN_SQL} as actor, {columns} from plays"


# What a parser yields from a missing text.
ON_MISSING = {"maj_flag": "0"}


def sparse_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = play_ops.sparse_union(detailed_plays(spark, sf_dir))
    return rows.drop("home_onice_code", "away_onice_code")


def _sparse_sql() -> str:
    columns = []
    for target in SPARSE_EVENT_COLUMNS.names:
        cases = []
        for code in PARSED_TYPES:
            expected = EXPECTED[code]
            source = play_ops.RENAMED[code].get(target, target)
            constant = source.startswith("=")
            expression = f"'{source[1:]}'" if constant else expected.get(source)
            if expression is None:
                continue
            if constant:
                missing = expression
            elif target.startswith("home_") or target == "faceoff_winner_home":
                missing = "false"
            else:
                missing = ON_MISSING.get(target) or "null"
            cases.append(
                f"when play_type = '{code}' then"
                f" case when event_id % 101 = 0 then {missing} else {expression} end"
            )
        columns.append(f"case {' '.join(cases)} end as {target}")
    keys = "game_id, away_team, home_team, index, period, status, play_type as type"
    return f"""{PLAYS} select {keys}, {a.detail_by_type()} as detail, time, time_elapsed,
      {", ".join(columns)} from plays"""


# ---- text documents -------------------------------------------------------------------------

def _document_sql() -> str:
    """One play text per event row, with one to four plays written from its columns."""
    play = (
        "cast(k + 1 as string) || '\\n' || cast(1 + k % 3 as string) || '\\n' || status || '\\n'"
        " || time_elapsed || time || '\\n' || play_type || '\\n' || own_team || ' event ' ||"
        " cast(k as string) || ' ft.' || '\\n' || '\\u00a0' || '\\n\\n' || cast(own_number as string)"
        " || '\\nC\\n' || cast(other_number as string) || '\\nG\\n'"
    )
    text = f"'header\\n' || array_join(transform(sequence(0, event_id % 4), k -> {play}), '')"
    notice = "case when event_id % 2 = 0 then 'Copyright notice\\nmore\\n' else '' end"
    return f"""select event_id as game_id, away_team, home_team, {text} || {notice} as text from plays"""


def tokenize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = a.run(spark, sf_dir, _document_sql(), plays=base(spark, sf_dir))
    rows = playtext.raw_plays(playtext.tokenize_plays(documents))
    return rows.withColumn("on_ice", F.array_join("on_ice", ",")).drop(
        "away_onice_array1", "home_onice_array1"
    )


TOKENIZE_SQL = f"""{PLAYS}
select event_id as game_id, away_team, home_team, cast(k + 1 as varchar) as index,
  cast(1 + k % 3 as varchar) as period, status, play_type as type,
  own_team || ' event ' || cast(k as varchar) || ' ft.' as detail, time, time_elapsed,
  cast(own_number as varchar) || ',C,' || cast(other_number as varchar) || ',G' as on_ice,
  cast((k % 3) * 1200 + (event_id % 20) * 60 + event_id * 7 % 60 as int) as time_elapsed_s,
  2 as num_on_ice
from plays, lateral (select unnest(range(0, event_id % 4 + 1)) as k) x"""


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return playtext.page_text(a.view(spark, sf_dir, "pages").select("page_id", "html"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return playtext.page_links(a.view(spark, sf_dir, "pages"), "page_id")


def _page_text_sql() -> str:
    text = "regexp_replace(html, '(?is)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "template"):
        text = rf"regexp_replace({text}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    text = f"regexp_replace({text}, '(?s)<[!/?a-zA-Z][^>]*>', '', 'g')"
    decode = (
        "case when regexp_extract(x, '^([0-9]{1,7});', 1) = '' then '&#' || x else"
        " chr(cast(regexp_extract(x, '^([0-9]{1,7});', 1) as int))"
        " || regexp_replace(x, '^[0-9]{1,7};', '') end"
    )
    pieces = f"string_split({text}, '&#')"
    text = f"{pieces}[1] || array_to_string(list_transform({pieces}[2:], lambda x: {decode}), '')"
    for reference, char in [
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&apos;", "''"),
        ("&nbsp;", " "),
        ("&copy;", "©"),
        ("&middot;", "·"),
        ("&amp;", "&"),
    ]:
        text = f"replace({text}, '{reference}', '{char}')"
    return f"select page_id, {text} as text from pages"


PAGE_LINKS_SQL = """
select page_id, cast(generate_subscripts(l, 1) - 1 as int) as place, unnest(l) as href
from (select page_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1) as l
  from pages)"""


QUERIES = {
    "on_off_share": (on_off_share, f"{SHARES} select {SHARE_COLUMNS} from shares"),
    "on_ice_attempts": (on_ice_attempts, _counts_sql("is_on")),
    "off_ice_attempts": (off_ice_attempts, _counts_sql("is_off")),
    "skater_toi": (skater_toi, f"{PLAYS}, {TOI} select * exclude (full_name), full_name as name from toi"),
    "teams_key": (
        teams_key,
        f"""{PLAYS}, {TOI} select side, count(distinct game_id) as games_played,
        cast(sum(toi_s) as bigint) as toi_s, sum(toi_s) / count(distinct game_id) as toipg
        from toi group by side""",
    ),
    "players_key": (
        players_key,
        f"""{PLAYS}, {TOI} select playerid, side, position, full_name as name,
        count(distinct game_id) as games_played, cast(sum(toi_s) as bigint) as toi_s,
        sum(toi_s) / count(distinct game_id) as toipg from toi group by all""",
    ),
    "game_detail": (
        game_detail,
        f"""{DETAIL} select {SHARE_COLUMNS}, full_name as name, position, plusminus, toi_s,
        evenstrengthtoi_s, corsi_for_per_es60, corsi_against_per_es60,
        corsi_for_per_es60 - corsi_against_per_es60 as corsi_per_es60 from detail""",
    ),
    "participant_summary": (participant_summary, _summary_sql()),
    "bucketed_detail": (
        bucketed_detail,
        f"""{DETAIL} select {SHARE_COLUMNS}, full_name as name, position, plusminus, toi_s,
        evenstrengthtoi_s, corsi_for_per_es60, corsi_against_per_es60,
        corsi_for_per_es60 - corsi_against_per_es60 as corsi_per_es60 from detail""",
    ),
    "append_summary": (append_summary, _summary_sql()),
    "clock_seconds": (clocks, CLOCKS_SQL),
    "split_participants": (split_participants, SPLIT_SQL),
    "participant_codes": (participant_codes, CODES_SQL),
    "attach_roster": (attach_roster, _attach_sql()),
    "parse_faceoff": (parser_query("FAC"), parser_sql("FAC")),
    "parse_hit": (parser_query("HIT"), parser_sql("HIT")),
    "parse_block": (parser_query("BLOCK"), parser_sql("BLOCK")),
    "parse_miss": (parser_query("MISS"), parser_sql("MISS")),
    "parse_giveaway": (parser_query("GIVE"), parser_sql("GIVE")),
    "parse_penalty": (parser_query("PENL"), parser_sql("PENL")),
    "parse_goal": (parser_query("GOAL"), parser_sql("GOAL")),
    "parse_takeaway": (parser_query("TAKE"), parser_sql("TAKE")),
    "parse_shot": (parser_query("SHOT"), parser_sql("SHOT")),
    "lineup_position": (lineup_position, _lineup_position_sql()),
    "sparse_union": (sparse_union, _sparse_sql()),
    "tokenize_text": (tokenize_text, TOKENIZE_SQL),
    "page_text": (page_text, _page_text_sql()),
    "page_links": (page_links, PAGE_LINKS_SQL),
}
