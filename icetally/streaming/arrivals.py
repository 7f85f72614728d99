"""Incremental load of newly landed payload files.

The file source remembers in its checkpoint which files it has read, so each run takes only what
arrived since. Rows are still matched by key against the stored table, because a game is fetched
again when the previous run ended on it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..sources import readers, sinks

PAYLOADS = "id string, payload string"


def load_new_files(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str,
    flatten: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
) -> None:
    """Flatten all payload files not read before and append their new rows to ``table``."""

    def append(batch: DataFrame, _batch_id: int) -> None:
        rows = flatten(batch)
        try:
            stored = readers.read_table(spark, table)
        except Exception as missing:  # first load: there is no table yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            fresh = rows.dropDuplicates(list(keys))
        else:
            fresh = readers.incremental_rows(rows, stored, keys)
        sinks.write_table(fresh, table, "append")

    arrived = spark.readStream.schema(PAYLOADS).parquet(landing)
    query = (
        arrived.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
