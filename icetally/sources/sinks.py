"""Writers: plain, compacted, bucketed and per-pair outputs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import MISSING
from .folders import exists, remove, shared_directory  # noqa: F401  (part of this module's interface)
from .readers import SEASON_FOLDER, season_of

NO_ARENA = -999  # fixed value: id of an arena without one
BUCKETS = 50  # fixed value: buckets of the analysis inputs

# Datasets that are compacted; the last two arrive as CSV.
SEASON_DATASETS = ["plays_sparse_detail", "corsi", "raw_forwards", "raw_defense", "raw_goalies"]
SEASONS = ["2021_2022", "2022_2023"]
CSV_DATASETS = ["ea_goaltending", "ea_skaters"]


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_seasons(df: DataFrame, path: str, key: str, mode: str = "overwrite") -> None:
    """Write one folder per season of the game key, which increments read selectively."""
    rows = df.withColumn(SEASON_FOLDER, season_of(F.col(key)))
    rows.hint("rebalance", F.col(SEASON_FOLDER)).write.mode(mode).partitionBy(SEASON_FOLDER).parquet(path)
    if mode == "overwrite":
        # A table without rows has no folder; an empty file keeps its columns readable.
        df.limit(0).write.parquet(f"{path}/{SEASON_FOLDER}=y")


def write_balanced(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write files of even, size-driven number: one for a small summary, many for a large table."""
    df.hint("rebalance").write.mode(mode).parquet(path)


def compact(df: DataFrame, path: str, files: int | None = None) -> None:
    """Rewrite a dataset as files of equal size: as many as its size needs, or a given number."""
    even = df.hint("rebalance") if files is None else df.repartition(files)
    even.write.mode("overwrite").parquet(path)


def manifest() -> list[tuple[str, str, str]]:
    """The compaction list: source path, format and target path, relative to their roots."""
    tables = [(f"{s}/{d}", "parquet", f"{s}/{d}") for d in SEASON_DATASETS for s in SEASONS]
    return tables + [(f"{d}.csv", "csv", d) for d in CSV_DATASETS]


def compact_all(
    spark: SparkSession,
    source_root: str,
    target_root: str,
    entries: Iterable[tuple[str, str, str]] | None = None,
    files: int | None = None,
) -> None:
    """Compact every dataset of the list; CSV sources become parquet."""
    for source, kind, target in entries if entries is not None else manifest():
        reader = spark.read.option("header", True) if kind == "csv" else spark.read
        compact(reader.format(kind).load(f"{source_root}/{source}"), f"{target_root}/{target}", files)


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    """Bucket number from 0 to ``buckets`` - 1. The key is hashed as it is: as a 32-bit float,
    neighbouring game ids would collapse into a handful of values."""
    return F.pmod(F.hash(key), F.lit(buckets)).cast("int")


def with_bucket(
    df: DataFrame, key: str, buckets: int = BUCKETS, name: str = "hashmod"
) -> DataFrame:
    return df.withColumn(name, bucket_of(F.col(key), buckets))


def write_bucketed(
    df: DataFrame,
    path: str,
    key: str = "game_id",
    buckets: int = BUCKETS,
    name: str = "hashmod",
    mode: str = "overwrite",
) -> None:
    """Write one directory per bucket of ``key``.

    Readers that filter on the bucket skip the other directories. Rows are rebalanced by bucket:
    adaptive execution splits a bucket that is larger than the advisory size over several tasks and
    joins small ones, so neither a hot key nor the size of the data overloads a task.
    """
    spread = with_bucket(df, key, buckets, name).hint("rebalance", F.col(name))
    spread.write.mode(mode).partitionBy(name).parquet(path)


def save_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """A copy of ``df`` below ``path`` that the catalog knows to be bucketed and sorted by ``keys``.

    Joins and groupings of such tables on their keys need no exchange and no sort. Rows go to their
    bucket's task first, so each bucket is one file; ``buckets`` should follow the data's size.
    """
    dealt = df.repartition(buckets, *[F.col(k) for k in keys])
    writer = dealt.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def pair_name(player_a: Column, player_b: Column) -> Column:
    """Last names of a pair, sorted and joined."""
    names = [F.element_at(F.split(p, " "), -1) for p in (player_a, player_b)]
    return F.array_join(F.array_sort(F.array(*names)), "_")


def write_pairs(df: DataFrame, path: str, parts: list[str]) -> None:
    """Replace the folders of the pairs in ``df`` and leave those of other pairs.

    A folder costs far more than its rows, so pairs are dealt over a fixed number of tasks, which
    adaptive execution doesn't join by size. All folders of a pair are one task's: where there are
    none yet, the driver moves a pair at a time and replaces nothing.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(tasks, F.col(parts[0])).write.partitionBy(*parts)
    if exists(df.sparkSession, path):
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def write_reports(report: DataFrame, tenures: DataFrame, path: str) -> None:
    """Write impact reports under pair, player and range of games."""
    bounds = tenures.select(
        "player_a", "player_b", F.concat_ws("-", "first_game", "last_game").alias("games")
    )
    rows = report.join(bounds, ["player_a", "player_b"]).withColumns(
        {
            "pair": pair_name(F.col("player_a"), F.col("player_b")),
            "player": F.col("player_last_name"),
        }
    )
    write_pairs(rows, path, ["pair", "player", "games"])


def stringify(df: DataFrame) -> DataFrame:
    """Every column as text, the missing marker for null."""
    return df.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in df.columns]
    )


def fill_arena(df: DataFrame, column: str = "arena_id") -> DataFrame:
    return df.fillna({column: NO_ARENA})
