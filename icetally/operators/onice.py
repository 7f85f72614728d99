"""Roster keys and the players on the ice for each play."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import on_ice_codes
from ..schemas import PLAY_COLUMNS, PLAY_KEY

SIDES = ("home", "away")
LISTS = {"code": "code", "names": "last_name", "ids": "player", "firstinit": "first_init"}


def split_name(df: DataFrame) -> DataFrame:
    """Replace the name map by the upper-case first initial and last name (``'A. ALPHA'``)."""
    name = F.upper(F.try_element_at(F.col("name"), F.lit("default")))
    parts = {
        "default_first_init": F.split_part(name, F.lit(". "), F.lit(1)),
        "default_last_name": F.nullif(F.split_part(name, F.lit(". "), F.lit(2)), F.lit("")),
    }
    return df.withColumns(parts).drop("name")


def roster_key(*rosters: DataFrame) -> DataFrame:
    """One row per listed player: game, side, on-ice code, id and name parts."""
    parts = [
        split_name(r.select("game_id", "side", "position", "sweaterNumber", "playerId", "name"))
        for r in rosters
    ]
    return reduce(DataFrame.unionByName, parts).select(
        F.col("game_id").cast("bigint").alias("game_id"),
        "side",
        F.concat("position", F.col("sweaterNumber").cast("string")).alias("code"),
        F.col("playerId").cast("string").alias("playerId"),
        "default_last_name",
        "default_first_init",
    )


def _entries(plays: DataFrame) -> DataFrame:
    """One narrow row per play, side and code; a side without codes gives one row with code ''."""
    sides = F.array(
        *[
            F.struct(
                F.lit(side).alias("which"),
                F.col(f"{side}_team").alias("side"),
                F.col(f"_{side}_codes").alias("codes"),
            )
            for side in SIDES
        ]
    )
    codes = F.when(F.size("s.codes") > 0, F.col("s.codes")).otherwise(F.array(F.lit("")))
    return (
        plays.select(*PLAY_KEY, F.explode(sides).alias("s"))
        .select(*PLAY_KEY, "s.which", "s.side", F.posexplode(codes).alias("pos", "code"))
        .where(F.col("side").isNotNull() & F.col("code").isNotNull())
    )


def _lists(which: str) -> list[Column]:
    chosen = (F.col("which") == which) & (F.col("code") != "")
    entry = F.struct(
        "pos",
        "code",
        F.col("default_last_name").alias("last_name"),
        F.col("playerId").alias("player"),
        F.col("default_first_init").alias("first_init"),
    )
    players = F.array_sort(F.collect_list(F.when(chosen, entry)))
    return [
        F.when(F.count_if(F.col("which") == which) > 0, players).alias(f"_{which}"),
    ]


def attach_on_ice(plays: DataFrame, *rosters: DataFrame) -> DataFrame:
    """Plays with the code, last name, id and first initial of the players on the ice, per side.

    ``rosters`` are the box score tables of forwards, defensemen and goalies. The four lists of a side stay aligned. Codes that are not on the side's roster are dropped. A
    side without codes gets empty lists if it has a roster at all; a side with nothing to match
    gets null lists, and plays where that holds for both sides are left out. Plays are identified
    by (game_id, index). Only the narrow exploded rows are joined and grouped; the play columns are
    shuffled once.
    """
    coded = plays.withColumns(
        {
            "game_id": F.col("game_id").cast("bigint"),
            **{f"_{s}_codes": on_ice_codes(F.col(f"{s}_onice_array1")) for s in SIDES},
        }
    )
    roster = roster_key(*rosters)
    blank = F.lit(None).cast("string")
    present = roster.select("game_id", "side").distinct().select(
        "game_id",
        "side",
        F.lit("").alias("code"),
        blank.alias("playerId"),
        blank.alias("default_last_name"),
        blank.alias("default_first_init"),
    )
    matched = _entries(coded).join(roster.unionByName(present), ["game_id", "side", "code"])
    lists = matched.groupBy(*PLAY_KEY).agg(*_lists("home"), *_lists("away"))
    columns = [
        F.col(f"_{side}.{field}").alias(f"{side}_onice_{name}")
        for side in SIDES
        for name, field in LISTS.items()
    ]
    return coded.select(*PLAY_COLUMNS).join(lists, PLAY_KEY).select(*PLAY_COLUMNS, *columns)
