"""Scans and the choice of which ids, batches and rows a job works on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.skew import FAN, overall_positions
from .folders import new_folder

# Season types, and the number of match-ups in each playoff round.
SEASON_TYPES = {"PR": "01", "R": "02", "P": "03"}
PLAYOFF_MATCHUPS = {1: 8, 2: 4, 3: 2, 4: 1}
PLAYOFF_GAMES = 7

SEASON_FOLDER = "load_season"
"""Partition column of stored tables; it follows from the game key."""


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan, with a declared schema where there is one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row, every column as text."""
    return spark.read.option("header", True).csv(path)


def id_range(spark: SparkSession, low: int, high: int) -> DataFrame:
    """Game ids from ``low`` up to, not including, ``high``."""
    return spark.range(low, high).withColumnRenamed("id", "game_id")


def missing_ids(wanted: DataFrame, landed: DataFrame, key: str = "game_id") -> DataFrame:
    """Wanted ids without a landed payload."""
    return wanted.join(landed.select(key), key, "left_anti")


def season_ids(seasons: DataFrame) -> DataFrame:
    """Numbered game ids of seasons given as ``year, season_type, games``."""
    number = F.explode(F.sequence(F.lit(1), F.col("games").cast("int"))).alias("number")
    rows = seasons.where(F.col("games") > 0).select("year", "season_type", number)
    key = F.concat(F.col("year").cast("string"), "season_type", F.lpad("number", F.greatest(F.length("number"), F.lit(4)), F.lit("0")))
    return rows.select("year", "season_type", key.alias("game_id"))


def playoff_ids(years: DataFrame) -> DataFrame:
    """All possible playoff game ids of each ``year``: round, match-up and game."""
    rounds = F.array(
        *[
            F.struct(F.lit(r).alias("round"), F.sequence(F.lit(0), F.lit(n - 1)).alias("matchups"))
            for r, n in PLAYOFF_MATCHUPS.items()
        ]
    )
    rows = years.select("year", F.inline(rounds)).select(
        "year", "round", F.explode("matchups").alias("matchup")
    )
    games = F.explode(F.sequence(F.lit(0), F.lit(PLAYOFF_GAMES - 1))).alias("game")
    parts = ["round", "matchup", "game"]
    key = F.concat(
        F.col("year").cast("string"),
        F.lit(SEASON_TYPES["P"]),
        F.lit("0"),
        *[F.col(p).cast("string") for p in parts],
    )
    return rows.select("*", games).select("year", *parts, key.alias("game_id"))


def high_water_marks(gameinfo: DataFrame) -> DataFrame:
    """Number of games and first and last key per season and game type."""
    return gameinfo.groupBy("season", "game_type").agg(
        F.count("game_pk").alias("games"),
        F.min("game_pk").alias("first_pk"),
        F.max("game_pk").alias("last_pk"),
    )


def high_water_mark(gameinfo: DataFrame, year: str, game_type: str) -> DataFrame:
    """The mark of one season (by its first year) and game type."""
    chosen = F.col("season").startswith(year) & (F.col("game_type") == game_type)
    if SEASON_FOLDER in gameinfo.columns:
        chosen &= F.col(SEASON_FOLDER) == F.lit(f"y{year}")
    return high_water_marks(gameinfo.where(chosen))


def season_of(key: Column) -> Column:
    """The folder of a game key: the year that it begins with. The letter keeps it text."""
    return F.concat(F.lit("y"), F.left(key.cast("string"), F.lit(4)))


def landing_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table without the column of its season folders."""
    return read_table(spark, path).drop(SEASON_FOLDER)


def same_seasons(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Stored rows of the seasons that arrived rows belong to.

    The seasons of an arrival are a handful of rows, one for each year, so they are sent to all
    tasks, and the scan of the stored table leaves out every other season's folder.
    """
    # The comparison tells the planner that the list is short: any folder name passes it.
    seasons = arrived.select(SEASON_FOLDER).where(F.col(SEASON_FOLDER) >= "y").distinct()
    return stored.join(F.broadcast(seasons), SEASON_FOLDER, "left_semi")


def incremental_rows(
    arrived: DataFrame, stored: DataFrame, keys: Sequence[str] = ("game_pk",)
) -> DataFrame:
    """Arrived rows whose key is not stored yet, once each.

    Running it twice adds nothing the second time, so an interrupted load is simply repeated. Where
    both have season folders (see ``same_seasons``), only those of the arrived rows are read.
    """
    if SEASON_FOLDER in arrived.columns and SEASON_FOLDER in stored.columns:
        stored = same_seasons(stored, arrived)
    return arrived.dropDuplicates(list(keys)).join(
        stored.select(*keys).distinct(), list(keys), "left_anti"
    )


def after_last(arrived: DataFrame, mark: DataFrame, key: str = "id") -> DataFrame:
    """Arrived rows whose key is past the last one of a mark (one row, or none: all rows). The key is
    compared as a constant, which reaches the scan."""
    last = mark.agg(F.max("last_pk")).first()[0]
    return arrived if last is None else arrived.where(F.col(key) > F.lit(last))


def after_mark(arrived: DataFrame, marks: DataFrame) -> DataFrame:
    """Arrived games past the last stored key of their season and type; all games of new seasons."""
    known = marks.select("season", "game_type", "last_pk")
    joined = arrived.join(known, ["season", "game_type"], "left")
    return joined.where(
        F.col("last_pk").isNull() | (F.col("game_pk") > F.col("last_pk"))
    ).drop("last_pk")


def batches(
    ids: DataFrame, batch_size: int, key: str = "id", block_width: int = 1_000_000, fan: int = FAN
) -> DataFrame:
    """Batch number of each unique id, in id order.

    Positions are counted over id blocks of ``block_width`` and groups of ``fan`` blocks, so no task
    sorts all ids or all blocks. The blocks' counts are stored in the shared folder.
    """
    blocked = ids.withColumn("_block", F.floor(F.col(key) / block_width))
    folder = new_folder(ids.sparkSession, "positions")
    placed = overall_positions(blocked, "_position", "_block", [key], folder, fan)
    batch = F.floor((F.col("_position") - 1) / batch_size).cast("int")
    return placed.withColumn("batch", batch).drop("_block", "_position")


def first_batches(batched: DataFrame, n_batches: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the first ``n_batches`` batches, and the rows left for a later run."""
    first = F.col("batch") < n_batches
    return batched.where(first), batched.where(~first)


def quarantine(rows: DataFrame, readable: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass the check, and the rest (an unknown check counts as failed)."""
    passed = F.coalesce(readable, F.lit(False))
    return rows.where(passed), rows.where(~passed)


def json_path(document: Column, *path: str | int) -> Column:
    """Value at a path of a JSON text, null if any level is absent."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path)
    return F.get_json_object(document, f"${steps}")
