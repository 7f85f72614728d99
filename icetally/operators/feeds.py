"""Nested game payloads to flat tables.

Payload tables hold one document per row, ``(id, payload)``. Parsing is row by row; the only rows a
document can fan out to are its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schemas import (
    BOX_SCORE,
    GOALIE_BOX,
    GOALIE_STATS,
    LIVE_FEED,
    SKATER_STATS,
    TEAM_LISTING,
)

SIDES = ("away", "home")


def parse(payloads: DataFrame, schema: str, paths: Sequence[str] = ()) -> DataFrame:
    """Read the JSON payload with a declared schema, or what of it lies at ``paths``; absent keys are
    null.

    The document is generated, a row for each row: what filters or explodes it later cannot be moved
    below the parsing, which would repeat it, and the writing of the payload, for each condition.
    """
    kind = narrowed(T.StructType.fromDDL(schema), paths) if paths else schema
    return payloads.select("*", F.explode(F.array(F.from_json("payload", kind))).alias("doc"))


def narrowed(kind: T.DataType, paths: Sequence[str]) -> T.DataType:
    """The fields of a structure that lead to the dotted ``paths``, and all that lies there."""
    if "" in paths:
        return kind
    steps = [path.partition(".") for path in paths]
    below = {f.name: [rest for first, _, rest in steps if first == f.name] for f in kind.fields}
    return T.StructType([T.StructField(f.name, narrowed(f.dataType, below[f.name])) for f in kind.fields if below[f.name]])


# ---- box score payloads --------------------------------------------------------------------


def _side_players(docs: DataFrame, group: str) -> DataFrame:
    """One row per listed player of either side, with the game and the side's abbreviation."""
    box = "doc.boxscore.playerByGameStats"
    sides = F.array(
        *[
            F.struct(
                F.try_element_at(F.col(f"doc.{s}Team"), F.lit("abbrev")).alias("side"),
                F.col(f"{box}.{s}Team.{group}").alias("players"),
            )
            for s in SIDES
        ]
    )
    return docs.select(F.col("doc.id").alias("game_id"), F.explode(sides).alias("s")).select(
        "game_id", "s.side", F.explode("s.players").alias("p")
    )


def box_score_skaters(docs: DataFrame, group: str) -> DataFrame:
    """Skaters of a box score; ``group`` is ``forwards`` or ``defense``."""
    return _side_players(docs, group).select("p.*", "game_id", "side")


def box_score_goalies(docs: DataFrame) -> DataFrame:
    """Goalies of a box score: the known keys as columns and every key found as a map."""
    entry = F.col("p")

    def value(field) -> Column:
        text = F.try_element_at(entry, F.lit(field.name))
        if field.name == "name":
            return F.from_json(text, field.dataType)
        return text.try_cast(field.dataType)

    known = [value(f).alias(f.name) for f in GOALIE_BOX]
    return _side_players(docs, "goalies").select(
        *known, "game_id", "side", entry.alias("attributes")
    )


def box_score_tables(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forwards, defensemen and goalies of all box scores."""
    docs = parsed(payloads, BOX_SCORE)
    return (
        box_score_skaters(docs, "forwards"),
        box_score_skaters(docs, "defense"),
        box_score_goalies(docs),
    )


def checked_box_scores(payloads: DataFrame) -> DataFrame:
    """``id``, ``doc``, ``readable`` and, of rows that aren't, ``payload``: whether a payload parses
    with the declared types and has a game id."""
    return _checked(payloads, BOX_SCORE, F.col("doc.id").isNotNull())


def _checked(payloads: DataFrame, schema: str, sound: Column) -> DataFrame:
    """Payloads parsed once, with the verdict. Rows with the same id stay."""
    broken = {"columnNameOfCorruptRecord": "_broken"}
    parsed = payloads.withColumn("doc", F.from_json("payload", f"{schema}, _broken string", broken))
    whole = F.col("doc").isNotNull() & F.col("doc._broken").isNull()
    verdict = F.coalesce(whole & sound, F.lit(False))
    return parsed.select(
        "id", F.col("doc").dropFields("_broken").alias("doc"), verdict.alias("readable"),
        F.when(~verdict, F.col("payload")).alias("payload"),
    )


def readable_rows(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed rows (``id, doc``), and the payloads (``id, payload``) that can't be read."""
    return (
        checked.where("readable").select("id", "doc"),
        checked.where(~F.col("readable")).select("id", "payload"),
    )


def parsed(rows: DataFrame, schema: str, paths: Sequence[str] = ()) -> DataFrame:
    """The rows if they hold parsed documents already, else parsed here."""
    return rows if "doc" in rows.columns else parse(rows, schema, paths)


def game_header(payloads: DataFrame) -> DataFrame:
    """One row per game."""
    return parsed(payloads, BOX_SCORE).select(
        F.col("doc.id").alias("game_id"),
        F.col("doc.season").alias("game_season"),
        F.col("doc.gameType").alias("game_type"),
        F.col("doc.gameDate").alias("game_date"),
        F.col("doc.venue").alias("game_venue"),
        F.col("doc.startTimeUTC").alias("game_start_time_utc"),
        F.col("doc.easternUTCOffset").alias("game_eastern_utc_offset"),
        F.col("doc.venueUTCOffset").alias("game_venue_utc_offset"),
        F.col("doc.gameScheduleState").alias("game_schedule_state"),
        F.col("doc.period").alias("game_period"),
        F.col("doc.gameOutcome.lastPeriodType").alias("game_last_period_type"),
    )


def game_teams(payloads: DataFrame) -> DataFrame:
    """Two rows per game: the away and the home team with all keys found, tagged by side."""
    teams = F.array(
        *[
            F.struct(F.lit(s).alias("game_team_side"), F.col(f"doc.{s}Team").alias("attributes"))
            for s in SIDES
        ]
    )
    return parsed(payloads, BOX_SCORE).select(
        F.col("doc.id").cast("string").alias("game_id"), F.inline(teams)
    )


def plays_documents(payloads: DataFrame, texts: DataFrame) -> DataFrame:
    """Play texts (``game_id, text``) with the team abbreviations of their box score."""
    docs = parsed(payloads, BOX_SCORE).select(
        F.col("doc.id").alias("game_id"),
        *[
            F.try_element_at(F.col(f"doc.{s}Team"), F.lit("abbrev")).alias(f"{s}_team")
            for s in SIDES
        ],
    )
    return texts.join(docs, "game_id").select("game_id", "away_team", "home_team", "text")


def discovered_keys(entries: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Every key that occurs in a map column, with the number of rows that have it."""
    return entries.select(F.explode(F.map_keys(attributes)).alias("key")).groupBy("key").count()


def variant_entries(payloads: DataFrame, group: str) -> DataFrame:
    """``game_id``, ``side``, ``key``, ``value``: every key of every player entry of a ``group``
    (``forwards``, ``defense`` or ``goalies``) with its value as a variant, whatever its type.

    The payload is parsed once, without a schema. Unreadable payloads and other shapes give no rows.
    """
    docs = payloads.select(F.try_parse_json("payload").alias("v"))
    sides = F.array(
        *[
            F.struct(
                F.lit(s).alias("side"),
                F.try_variant_get("v", f"$.boxscore.playerByGameStats.{s}Team.{group}", "array<variant>").alias("players"),
            )
            for s in SIDES
        ]
    )
    game = F.try_variant_get("v", "$.id", "bigint").alias("game_id")
    entries = docs.select(game, F.inline(sides)).select("game_id", "side", F.explode("players").alias("p"))
    fields = F.explode(F.try_variant_get("p", "$", "map<string,variant>")).alias("key", "value")
    return entries.select("game_id", "side", fields)


def discovered_types(entries: DataFrame) -> DataFrame:
    """Every key of ``variant_entries`` with the number of entries that have it and the narrowest type
    that holds all of its values."""
    return entries.groupBy("key").agg(
        F.count(F.lit(1)).alias("count"), F.schema_of_variant_agg("value").alias("type")
    )


def widen(entries: DataFrame, keys: list[str], attributes: str = "attributes") -> DataFrame:
    """Map column to one column per key, keys in sorted order."""
    wide = [F.try_element_at(F.col(attributes), F.lit(k)).alias(k) for k in sorted(keys)]
    return entries.select(*[c for c in entries.columns if c != attributes], *wide)


def align_by_name(parts: list[DataFrame]) -> DataFrame:
    """Union of frames with different discovered columns, matched by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# ---- live feed payloads --------------------------------------------------------------------


def checked_feeds(payloads: DataFrame) -> DataFrame:
    """``id``, ``doc``, ``readable`` and, of rows that aren't, ``payload``: whether a payload parses
    with a game key and at most one head coach a side. One without data (of that message number) is
    readable."""
    single = [F.coalesce(F.size(_head_coaches(side)) <= 1, F.lit(True)) for side in SIDES]
    no_data = F.coalesce(F.col("doc.messageNumber") == 2, F.lit(False))
    keyed = F.col("doc.gameData.game.pk").isNotNull()
    return _checked(payloads, LIVE_FEED, (no_data | keyed) & single[0] & single[1])


def readable_feeds(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed feeds (``id, doc``) that can be read, and the payloads (``id, payload``) of the rest."""
    return readable_rows(checked_feeds(payloads))


def finished(docs: DataFrame) -> DataFrame:
    """Parsed feeds of finished games; feeds without data are dropped."""
    no_data = F.coalesce(F.col("doc.messageNumber") == 2, F.lit(False))
    return docs.where(~no_data & (F.col("doc.gameData.status.detailedState") == "Final"))


def complete_feeds(payloads: DataFrame, paths: Sequence[str] = ()) -> DataFrame:
    """Payloads of finished games, parsed, or what lies at ``paths`` of them beside the state."""
    read = ["messageNumber", "gameData.status", *paths] if paths else ()
    return finished(parsed(payloads, LIVE_FEED, read))


def _truth(text: Column) -> Column:
    """JSON booleans as they are spelled in the landing tables."""
    return F.when(text.isin("true", "false"), F.initcap(text)).otherwise(text)


# Names of team statistics, decisions and period values in the payloads.
TEAM_STAT_NAMES = {
    "goals": "goals",
    "pim": "pim",
    "shots": "shots",
    "pp_pct": "powerPlayPercentage",
    "ppgoal": "powerPlayGoals",
    "ppcount": "powerPlayOpportunities",
    "fowinpct": "faceOffWinPercentage",
    "blocks": "blocked",
    "takeaways": "takeaways",
    "giveaways": "giveaways",
    "hits": "hits",
}
DECISIONS = {
    "winning_goaltender": "winner",
    "losing_goaltender": "loser",
    "first_star": "firstStar",
    "second_star": "secondStar",
    "third_star": "thirdStar",
}


def _head_coaches(side: str) -> Column:
    coaches = F.filter(
        F.col(f"doc.liveData.boxscore.teams.{side}.coaches"), lambda c: c["position"]["code"] == "HC"
    )
    return F.transform(coaches, lambda c: c["person"]["fullName"])


def _head_coach(side: str) -> Column:
    """Name of the head coach; null without one, and with several (see ``readable_feeds``)."""
    names = _head_coaches(side)
    return F.when(F.size(names) == 1, F.get(names, F.lit(0)))


def _period(kind: str, number: int, side: str, key: str) -> Column:
    """A value of one period; the last entry wins if a period is listed twice."""
    periods = F.filter(
        F.col("doc.liveData.linescore.periods"),
        lambda p: (p["periodType"] == kind) & (p["num"] == number),
    )
    return F.try_element_at(periods, F.lit(-1))[side][key]


# Period values by their published suffix.
PERIOD_KEYS = {"goals": "goals", "shots": "shotsOnGoal", "rink_side": "rinkSide"}


def _period_columns() -> list[Column]:
    """Regulation periods 1-3, overtime 4 (missing: null) and the shootout."""
    listed = [("REGULAR", f"p{n}", n) for n in (1, 2, 3)] + [("OVERTIME", "ot4", 4)]
    columns = [
        _period(kind, number, side, key).alias(f"{prefix}_{side}_{name}")
        for kind, prefix, number in listed
        for side in SIDES
        for name, key in PERIOD_KEYS.items()
    ]
    shootout = "doc.liveData.linescore.shootoutInfo"
    for side in SIDES:
        columns += [
            F.col(f"{shootout}.{side}.attempts").alias(f"so_attempts_{side}"),
            F.col(f"{shootout}.{side}.scores").alias(f"so_goals_{side}"),
        ]
    return columns


def overtime_goals() -> list[Column]:
    """Goals of all overtimes, as the winner needs them; null without overtime."""

    def scored(side: str) -> Column:
        overtimes = F.filter(
            F.col("doc.liveData.linescore.periods"), lambda p: p["periodType"] == "OVERTIME"
        )
        goals = F.transform(overtimes, lambda p: F.coalesce(p[side]["goals"].try_cast("int"), F.lit(0)))
        total = F.aggregate(goals, F.lit(0), lambda a, b: a + b)
        return F.when(F.size(overtimes) > 0, total).alias(f"overtime_{side}_goals")

    return [scored(side) for side in SIDES]


def unknown_period_types(feeds: DataFrame) -> DataFrame:
    """Feeds listing a period that is neither regulation nor overtime, to be looked into."""
    known = ["REGULAR", "OVERTIME", "SHOOTOUT"]
    odd = F.filter(
        F.col("doc.liveData.linescore.periods"), lambda p: ~p["periodType"].isin(known)
    )
    return feeds.where(F.size(odd) > 0).select("id", odd.alias("periods"))


def period_stats(feeds: DataFrame) -> DataFrame:
    """Period scores, one wide row per game."""
    return feeds.select(F.col("doc.gameData.game.pk").alias("game_pk"), *_period_columns())


def game_info(feeds: DataFrame) -> DataFrame:
    """One wide row per finished game; an arena without id gets -999."""
    game, live = "doc.gameData", "doc.liveData"
    teams = [
        F.col(f"{game}.teams.{side}.{key}").alias(f"team_{side}_{name}")
        for side in SIDES
        for name, key in (("id", "id"), ("name", "name"), ("shortname", "shortName"))
    ]
    decisions = [
        F.col(f"{live}.decisions.{who}.{key}").alias(f"{name}_{suffix}")
        for suffix, key in (("id", "id"), ("name", "fullName"))
        for name, who in DECISIONS.items()
    ]
    stats = [
        F.col(f"{live}.boxscore.teams.{side}.teamStats.teamSkaterStats.{key}").alias(
            f"{side}_{name}"
        )
        for side in SIDES
        for name, key in TEAM_STAT_NAMES.items()
    ]
    return feeds.select(
        F.col(f"{game}.game.pk").alias("game_pk"),
        F.col(f"{game}.game.season").alias("season"),
        F.col(f"{game}.game.type").alias("game_type"),
        F.col(f"{game}.datetime.dateTime").alias("game_start"),
        F.col(f"{game}.datetime.endDateTime").alias("game_end"),
        F.col(f"{game}.status.detailedState").alias("game_state"),
        _truth(F.col(f"{game}.status.startTimeTBD")).alias("game_time_tbd"),
        *teams,
        *decisions,
        F.coalesce(f"{game}.venue.id", F.lit("-999")).alias("arena_id"),
        F.col(f"{game}.venue.name").alias("name"),
        *stats,
        *[_head_coach(side).alias(f"head_coach_{side}") for side in SIDES],
        *_period_columns(),
        *overtime_goals(),
    )


# Published name -> path within a player's entry.
PLAYER_INFO = {
    "player_id_num": "id",
    "fullName": "fullName",
    "firstName": "firstName",
    "lastName": "lastName",
    "primaryNumber": "primaryNumber",
    "birthDate": "birthDate",
    "currentAge": "currentAge",
    "birthCity": "birthCity",
    "birthStateProvince": "birthStateProvince",
    "birthCountry": "birthCountry",
    "nationality": "nationality",
    "height": "height",
    "weight": "weight",
    "active": "active",
    "captain": "captain",
    "alternateCaptain": "alternateCaptain",
    "rookie": "rookie",
    "shootsCatches": "shootsCatches",
    "rosterStatus": "rosterStatus",
    "currentTeamId": "currentTeam.id",
    "currentTeamName": "currentTeam.name",
    "currentTeamCode": "currentTeam.triCode",
    "primaryPositionCode": "primaryPosition.code",
    "primaryPositionName": "primaryPosition.name",
    "primaryPositionType": "primaryPosition.type",
    "primaryPositionAbbr": "primaryPosition.abbreviation",
}


def player_info(feeds: DataFrame) -> DataFrame:
    """One row per player listed in a game; the row key is game and player."""
    rows = feeds.select("id", F.explode("doc.gameData.players").alias("player_id", "p"))
    return rows.select(
        "player_id",
        *[_truth(F.col(f"p.{path}")).alias(name) for name, path in PLAYER_INFO.items()],
        F.concat("id", "player_id").alias("index_val"),
    )


def player_stats(feeds: DataFrame) -> DataFrame:
    """One row per player and game with the skater and the goalie block."""
    sides = F.array(
        *[
            F.struct(
                F.lit(side).alias("player_teamtype"),
                F.col(f"doc.liveData.boxscore.teams.{side}.players").alias("players"),
            )
            for side in SIDES
        ]
    )
    rows = feeds.select("id", F.inline(sides)).select(
        "id", "player_teamtype", F.explode("players").alias("player_key", "p")
    )
    return rows.select(
        "player_teamtype",
        F.col("p.person.id").alias("player_id"),
        F.col("p.person.fullName").alias("player_fullname"),
        F.col("p.person.shootsCatches").alias("player_handed"),
        F.col("p.person.rosterStatus").alias("player_rosterStatus"),
        F.col("p.jerseyNumber").alias("player_jersey_number"),
        F.col("p.position.code").alias("player_poscode"),
        F.col("p.position.name").alias("player_position"),
        F.col("p.position.type").alias("player_postype"),
        F.col("p.position.abbreviation").alias("player_posabbrev"),
        *[F.col(f"p.stats.skaterStats.{c}").alias(c) for c in SKATER_STATS],
        *[F.col(f"p.stats.goalieStats.{c}").alias(f"gt_{c}") for c in GOALIE_STATS],
        F.concat("id", "player_key").alias("index_val"),
    )


def officials(feeds: DataFrame) -> DataFrame:
    """One row per official and game."""
    rows = feeds.select("id", F.explode("doc.liveData.boxscore.officials").alias("o"))
    return rows.select(
        F.col("id").alias("game_id"),
        F.col("o.official.id").alias("official_id"),
        F.col("o.official.fullName").alias("official_name"),
        F.col("o.official.officialType").alias("official_type"),
    )


def feed_plays(feeds: DataFrame) -> DataFrame:
    """One row per play of the feed, with its place in the list."""
    rows = feeds.select("id", F.posexplode("doc.liveData.plays.allPlays").alias("place", "p"))
    return rows.select(
        F.col("id").alias("game_id"),
        "place",
        "p.result.*",
        "p.about.*",
        "p.coordinates.*",
        F.concat_ws("_", "id", "place").alias("index_val"),
    )


def teams(payloads: DataFrame) -> DataFrame:
    """One flat row per team of the team listing payloads."""
    return parse(payloads, f"teams array<struct<{TEAM_LISTING}>>").select(
        F.explode("doc.teams").alias("t")
    ).select(
        F.col("t.id").alias("team_id"),
        F.col("t.name").alias("name"),
        F.col("t.venue.name").alias("venue"),
        F.col("t.venue.city").alias("city"),
        F.col("t.abbreviation").alias("abbreviation"),
        F.col("t.teamName").alias("teamName"),
        F.col("t.locationName").alias("location"),
        F.col("t.firstYearOfPlay").alias("firstSeason"),
        F.col("t.division.id").alias("division_id"),
        F.col("t.division.name").alias("division_name"),
        F.col("t.conference.id").alias("conference_id"),
        F.col("t.conference.name").alias("conference_name"),
        F.col("t.shortName").alias("shortName"),
        F.col("t.franchiseId").alias("franchiseId"),
        F.col("t.firstYearOfPlay").alias("firstYearOfPlay"),
    )


