"""Shot-attempt (Corsi) metrics for all teams and players in one job.

On-ice counts come from one exploded aggregate per (game, team, player). Off-ice counts are not
queried again: they are the team's total minus the player's count, both restricted to plays whose
two on-ice lists are known, because a missing list satisfies neither "in" nor "not in".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import empty_strings
from ..functions.text import clock_seconds, holds
from ..schemas import ATTEMPT_TYPES

# Names of the eight counts, by event code.
COUNT_NAMES = {"SHOT": "shots", "GOAL": "goals", "MISS": "misses", "BLOCK": "blocks"}
DIRECTIONS = ("for", "against")
COUNTS = [f"{kind}_{way}" for kind in COUNT_NAMES.values() for way in DIRECTIONS]
KNOWN = "known_"  # prefix of counts over plays with both on-ice lists known

# Columns of the box score that the ice time is taken from.
TOI_COLUMNS = [
    "game_id",
    "playerid",
    "side",
    "name",
    "plusminus",
    "powerplaytoi",
    "shorthandedtoi",
    "toi",
    "position",
]


def skater_toi(forwards: DataFrame, defense: DataFrame) -> DataFrame:
    """Ice time in seconds per skater and game; even strength is what special teams leave."""
    skaters = forwards.select(*TOI_COLUMNS).unionByName(defense.select(*TOI_COLUMNS))
    seconds = {
        f"{clock}_s": clock_seconds(F.col(clock))
        for clock in ("toi", "powerplaytoi", "shorthandedtoi")
    }
    even = F.col("toi_s") - F.col("powerplaytoi_s") - F.col("shorthandedtoi_s")
    return skaters.withColumns(seconds).withColumn("evenstrengthtoi_s", even)


def _usage() -> list[Column]:
    games, seconds = F.countDistinct("game_id"), F.sum("toi_s")
    return [
        games.alias("games_played"),
        seconds.alias("toi_s"),
        F.try_divide(seconds, games).alias("toipg"),
    ]


def teams_key(toi: DataFrame) -> DataFrame:
    """Games and ice time per team."""
    return toi.groupBy("side").agg(*_usage())


def players_key(toi: DataFrame, team: str | None = None) -> DataFrame:
    """Games and ice time per player, team, position and name."""
    rows = toi if team is None else toi.where(F.col("side") == team)
    name = F.try_element_at(F.col("name"), F.lit("default")).alias("name")
    return rows.groupBy("playerid", "side", "position", name).agg(*_usage())


def _attempts(plays: DataFrame, status: str | None) -> DataFrame:
    """One row per attempt and team in the game, seen from that team."""
    rows = plays.where(F.col("type").isin(ATTEMPT_TYPES))
    if status is not None:
        rows = rows.where(F.col("status") == status)
    team = F.explode(F.array_distinct(F.array("home_team", "away_team"))).alias("team")
    home, away = F.col("home_onice_ids"), F.col("away_onice_ids")
    nobody = empty_strings()
    return rows.select(
        "game_id",
        team,
        "type",
        "shooter_team",
        (home.isNotNull() & away.isNotNull()).alias("lists_known"),
        F.array_distinct(F.concat(F.coalesce(home, nobody), F.coalesce(away, nobody))).alias(
            "players"
        ),
    ).where(F.col("team").isNotNull())


def _tallies(known_only: bool) -> list[Column]:
    """The eight counts; an attempt with unknown shooter counts against."""
    is_for = holds(F.col("team") == F.col("shooter_team"))
    columns = []
    for code, kind in COUNT_NAMES.items():
        for way, condition in zip(DIRECTIONS, (is_for, ~is_for)):
            chosen = (F.col("type") == code) & condition
            if known_only:
                chosen = chosen & F.col("lists_known")
            prefix = KNOWN if known_only else ""
            columns.append(F.count_if(chosen).alias(f"{prefix}{kind}_{way}"))
    return columns


def on_ice_attempts(plays: DataFrame, status: str | None = None) -> DataFrame:
    """Counts per game, team and player on the ice, over all plays and over plays with known lists."""
    return _counts(plays, status).where(F.col("player_id").isNotNull())


def _counts(plays: DataFrame, status: str | None) -> DataFrame:
    """The counts of players, and of whole teams under a null player, from one reading."""
    on_ice = F.filter("players", lambda p: p.isNotNull())
    anybody = F.array(F.lit(None).cast("string"))
    return (
        _attempts(plays, status)
        .withColumn("player_id", F.explode(F.concat(on_ice, anybody)))
        .groupBy("game_id", "team", "player_id")
        .agg(*_tallies(False), *_tallies(True))
    )


def _beside_team(counts: DataFrame, own: dict[str, Column], team: dict[str, Column]) -> DataFrame:
    """Columns of each player and of the player's team. A window has a game and team, some tens
    of players."""
    whole = Window.partitionBy("game_id", "team")
    totals = {
        name: F.max(F.when(F.col("player_id").isNull(), value)).over(whole)
        for name, value in team.items()
    }
    columns = [value.alias(name) for name, value in {**own, **totals}.items()]
    rows = counts.select("game_id", "team", "player_id", *columns)
    return rows.where(F.col("player_id").isNotNull())


def _total(way: str, prefix: str = "") -> Column:
    return reduce(Column.__add__, [F.col(f"{prefix}{k}_{way}") for k in COUNT_NAMES.values()])


def _share(prefix: str) -> dict[str, Column]:
    made, allowed = F.col(f"{prefix}corsi_for"), F.col(f"{prefix}corsi_against")
    return {
        f"{prefix}corsi": made - allowed,
        f"{prefix}corsi_for_pct": F.try_divide(made, made + allowed),
    }


def with_totals(counts: DataFrame) -> DataFrame:
    """Add ``corsi_for``, ``corsi_against``, their difference and the share."""
    totals = {f"corsi_{way}": _total(way) for way in DIRECTIONS}
    return counts.withColumns(totals).withColumns(_share(""))


def off_ice_attempts(plays: DataFrame, status: str | None = None) -> DataFrame:
    """The eight counts per game, team and player while the player was in neither list.

    Covers players seen on the ice in that game; games without off-ice attempts are left out.
    """
    both = _beside_team(
        _counts(plays, status),
        {f"_{c}": F.col(KNOWN + c) for c in COUNTS},
        {f"{c}_team": F.col(KNOWN + c) for c in COUNTS},
    )
    counts = {c: F.col(f"{c}_team") - F.col(f"_{c}") for c in COUNTS}
    rows = both.select("game_id", "team", "player_id", *[v.alias(c) for c, v in counts.items()])
    return with_totals(rows).where(F.col("corsi_for") + F.col("corsi_against") > 0)


def player_attempts_by_game(plays: DataFrame, status: str | None = None) -> DataFrame:
    """On-ice and off-ice shares and their difference, per game, team and player."""
    own = {f"corsi_{way}": _total(way) for way in DIRECTIONS}
    own |= {f"goals_{way}": F.col(f"goals_{way}") for way in DIRECTIONS}
    own |= {f"_on_{way}": _total(way, KNOWN) for way in DIRECTIONS}
    team_columns = {f"_team_{way}": _total(way, KNOWN) for way in DIRECTIONS}
    both = _beside_team(_counts(plays, status), own, team_columns)
    off = {f"rel_corsi_{way}": F.col(f"_team_{way}") - F.col(f"_on_{way}") for way in DIRECTIONS}
    return (
        both.withColumns(off)
        .where(F.col("rel_corsi_for") + F.col("rel_corsi_against") > 0)
        .withColumns(_share("") | _share("rel_"))
        .withColumn("corsi_for_relative_pct", F.col("corsi_for_pct") - F.col("rel_corsi_for_pct"))
        .select(
            "game_id",
            "team",
            "player_id",
            "corsi_for",
            "corsi_against",
            "corsi",
            "corsi_for_pct",
            "goals_for",
            "goals_against",
            "rel_corsi_for",
            "rel_corsi_against",
            "rel_corsi",
            "rel_corsi_for_pct",
            "corsi_for_relative_pct",
        )
    )


def game_detail(
    plays: DataFrame, toi: DataFrame, team: str | None = None, status: str | None = None
) -> DataFrame:
    """Per game and player: attempt metrics, ice time and rates per sixty even-strength minutes.

    The ice-time row must be of the same game, player and team, so a traded player is not analysed
    in games against the former team. ``team`` limits the result to one team.
    """
    if team is not None:
        plays = plays.where((F.col("home_team") == team) | (F.col("away_team") == team))
        toi = toi.where(F.col("side") == team)
    metrics = player_attempts_by_game(plays, status)
    player_toi = toi.withColumns(
        {"player_id": F.col("playerid").cast("string"), "team": F.col("side")}
    )
    return _with_rates(metrics.join(player_toi, ["game_id", "team", "player_id"]))


def game_detail_in_place(plays: DataFrame, toi: DataFrame, status: str | None = None) -> DataFrame:
    """``game_detail`` for tables that are bucketed by game: nothing is exchanged.

    Counts are grouped within games, which the buckets allow. A join on game, team and player would
    deal both sides anew, so the join is on the game alone: a game's ice time is one list of some
    forty skaters, in which each player looks up their own.
    """
    metrics = player_attempts_by_game(plays, status)
    times = toi.groupBy("game_id").agg(
        F.collect_list(F.struct(*[c for c in toi.columns if c != "game_id"])).alias("times")
    )
    own = F.filter(
        "times", lambda t: (t["side"] == F.col("team")) & (t["playerid"].cast("string") == F.col("player_id"))
    )
    joined = metrics.hint("merge").join(times, "game_id").select(*metrics.columns, F.inline(own))
    return _with_rates(joined)


def _with_rates(rows: DataFrame) -> DataFrame:
    per_hour = F.try_divide(F.lit(3600.0), F.col("evenstrengthtoi_s").cast("double"))
    rates = {f"corsi_{way}_per_es60": F.col(f"corsi_{way}") * per_hour for way in DIRECTIONS}
    return rows.withColumns(rates).withColumn(
        "corsi_per_es60", F.col("corsi_for_per_es60") - F.col("corsi_against_per_es60")
    )


# Measures of the player summary in their published order; plus-minus is summed.
MEASURES = [
    "corsi_for",
    "corsi_against",
    "corsi",
    "corsi_for_pct",
    "goals_for",
    "goals_against",
    "rel_corsi_for",
    "rel_corsi_against",
    "rel_corsi",
    "rel_corsi_for_pct",
    "corsi_for_relative_pct",
    "plusminus",
    "toi_s",
    "evenstrengthtoi_s",
    "corsi_for_per_es60",
    "corsi_against_per_es60",
]
AVERAGED = [c for c in MEASURES if c != "plusminus"]


def team_summary(detail: DataFrame, toi: DataFrame, team: str | None = None) -> DataFrame:
    """Per player and team: usage from the ice-time table, unweighted means of the game metrics."""
    means = detail.groupBy(F.col("playerid"), F.col("team").alias("side")).agg(
        *[F.avg(c).alias(c) for c in AVERAGED],
        F.avg("corsi_per_es60").alias("average_corsi_per_60"),
        F.sum("plusminus").alias("plusminus"),
    )
    players = players_key(toi, team).drop("toi_s")
    return players.join(means, ["playerid", "side"], "left").select(
        "playerid",
        "name",
        "position",
        "games_played",
        "toipg",
        *MEASURES,
        "average_corsi_per_60",
        F.col("side").alias("team"),
    )


# ---- summaries that new games are added to ---------------------------------------------------

STATE_KEY = ["playerid", "side"]
MEANS = [*AVERAGED, "corsi_per_es60"]


def summary_state(detail: DataFrame, toi: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``team_summary`` needs of some games, in a form that adds up with that of other games:
    sums and counts of the game metrics per player and team, and usage per player, team, position
    and name."""
    sums = [F.sum(c).alias(f"sum_{c}") for c in MEANS] + [F.count(c).alias(f"n_{c}") for c in MEANS]
    metrics = detail.groupBy("playerid", F.col("team").alias("side")).agg(*sums, F.sum("plusminus").alias("plusminus"))
    return metrics, players_key(toi).drop("toipg")


def merged_state(metrics: DataFrame, usage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per key from the states of any number of disjoint sets of games."""
    added = [c for c in metrics.columns if c not in STATE_KEY]
    games, seconds = F.sum("games_played"), F.sum("toi_s")
    return (
        metrics.groupBy(*STATE_KEY).agg(*[F.sum(c).alias(c) for c in added]),
        usage.groupBy(*STATE_KEY, "position", "name").agg(
            games.alias("games_played"), seconds.alias("toi_s"), F.try_divide(seconds, games).alias("toipg")
        ),
    )


def summary_of_state(metrics: DataFrame, usage: DataFrame) -> DataFrame:
    """The summary of all games in a merged state, with the columns of ``team_summary``."""
    means = {c: F.try_divide(F.col(f"sum_{c}"), F.col(f"n_{c}")) for c in MEANS}
    named = metrics.select(
        *STATE_KEY, "plusminus", *[m.alias(c) for c, m in means.items() if c in AVERAGED],
        means["corsi_per_es60"].alias("average_corsi_per_60"),
    )
    return usage.drop("toi_s").join(named, STATE_KEY, "left").select(
        "playerid", "name", "position", "games_played", "toipg", *MEASURES, "average_corsi_per_60",
        F.col("side").alias("team"),
    )
