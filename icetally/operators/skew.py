"""Joins and running counts that hold when one key carries a large share of the rows.

Adaptive execution already splits skewed partitions of sort-merge joins and turns a join into a
broadcast join when the measured size of a side allows it; joins of two large tables rely on that,
and nothing in this package forces a broadcast. These helpers cover the rest: joins of many rows per
key to a far smaller table, and window functions over a hot key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources.folders import new_folder

SALTS = 8


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once below the shared folder: what follows reads them as often as it likes,
    and a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


HEAVY_SHARE = 1 / 64
"""A key with more of the rows than this is heavy, so there are fewer than 64 of them."""


def heavy_salts(facts: DataFrame, on: Sequence[str], share: float = HEAVY_SHARE) -> dict[int, int]:
    """How many parts each heavy key's rows should be dealt over, by the hash of the key.

    One aggregate: a frequent-items sketch of the keys' hashes, whose size doesn't grow with the
    data and whose counts are never too low for a key with that share. ``facts`` are read once more,
    so they should be stored.
    """
    sizes = F.lit(int(2 / share)), F.lit(int(64 / share))
    most = F.call_function("approx_top_k", F.xxhash64(*on), *sizes).alias("top")
    row = facts.agg(F.count(F.lit(1)).alias("n"), most).first()
    limit = max(1.0, row["n"] * share)
    return {t["item"]: -int(-t["count"] // limit) + 1 for t in row["top"] or [] if t["count"] > limit}


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    salts: int | dict[int, int] = SALTS,
) -> DataFrame:
    """Join many ``facts`` per key to few ``lookup`` rows per key.

    The rows of one key are spread over ``salts`` partitions by the columns ``spread``, which should
    vary within a key; the lookup side is repeated once per salt. With ``heavy_salts`` only heavy
    keys are spread, and no other key's lookup rows are repeated. ``how`` must keep the fact side
    (inner, left, left_semi).
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"a salted join cannot keep unmatched lookup rows: {how}")
    if isinstance(salts, dict):
        listed = [F.lit(x) for pair in salts.items() for x in pair]
        parts = F.coalesce(F.try_element_at(F.create_map(*listed), F.xxhash64(*on)), F.lit(1)) if salts else F.lit(1)
    else:
        parts = F.lit(salts)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), parts).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def ordered_positions(
    df: DataFrame,
    scopes: Mapping[str, Sequence[str]],
    block: str,
    order: Sequence[str | Column],
) -> DataFrame:
    """``row_number()`` per scope without sorting a whole scope in one task.

    ``scopes`` maps a new column to the keys it is numbered within. ``block`` is a coarse,
    order-preserving function of the order columns (a season, a range of ids). Rows are numbered
    within the finest key and block only; the rows of earlier blocks are counted on a
    pre-aggregated table with one row per key and block, and added.
    """
    finest = list(dict.fromkeys([*(key for keys in scopes.values() for key in keys), block]))
    sizes = df.groupBy(*finest).agg(F.count(F.lit(1)).alias("_rows"))

    def rows_before(keys: Sequence[str]) -> Column:
        earlier = Window.partitionBy(*keys).orderBy(block)
        earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_rows").over(earlier), F.lit(0))

    offsets = sizes.select(
        *finest, *[rows_before(keys).alias(f"_before_{name}") for name, keys in scopes.items()]
    )
    inside = Window.partitionBy(*finest).orderBy(*order)
    numbered = df.withColumn("_inside", F.row_number().over(inside)).join(offsets, finest)
    positions = {name: F.col(f"_before_{name}") + F.col("_inside") for name in scopes}
    return numbered.withColumns(positions).drop("_inside", *[f"_before_{n}" for n in scopes])


FAN = 1024


def overall_positions(
    df: DataFrame, name: str, block: str, order: Sequence[str | Column], folder: str, fan: int = FAN
) -> DataFrame:
    """``row_number()`` over all rows, for a whole-numbered ``block`` that keeps the order.

    Rows are numbered within their block. The rows before each block are a prefix sum: the counts of
    blocks are stored below ``folder``, then on the way up the sums of ``fan`` neighbours, until a
    level has at most ``fan`` of them; on the way down each node adds what its earlier siblings hold
    to what lies before its parent. Every level is written once and is a ``fan``-th of the one
    below, and no window has more rows than ``fan``.
    """
    session = df.sparkSession
    counts = df.groupBy(F.col(block).cast("bigint").alias("node")).agg(F.count(F.lit(1)).alias("held"))
    levels: list[DataFrame] = []
    while True:
        path = f"{folder}/level-{len(levels)}"
        counts.withColumn("parent", F.floor(F.col("node") / fan)).write.parquet(path)
        levels.append(session.read.schema("node bigint, held bigint, parent bigint").parquet(path))
        if levels[-1].count() <= fan:
            break
        counts = levels[-1].groupBy(F.col("parent").alias("node")).agg(F.sum("held").alias("held"))
    before = F.coalesce(F.sum("held").over(_earlier("parent")), F.lit(0)).alias("before")
    # The topmost level has few nodes, whatever their parents are: it is one window.
    top = levels[-1].withColumn("parent", F.lit(0).cast("bigint"))
    offsets = top.select("node", before)
    for level in reversed(levels[:-1]):
        above = offsets.select(F.col("node").alias("parent"), F.col("before").alias("above"))
        offsets = level.select("node", "parent", before).join(above, "parent")
        offsets = offsets.select("node", (F.col("before") + F.col("above")).alias("before"))
    inside = Window.partitionBy(block).orderBy(*order)
    numbered = df.withColumn("_inside", F.row_number().over(inside))
    offsets = offsets.select(F.col("node").alias("_node"), F.col("before").alias("_before"))
    placed = numbered.join(offsets, numbered[block] == F.col("_node"))
    return placed.withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside", "_node")


def _earlier(parent: str):
    window = Window.partitionBy(parent).orderBy("node")
    return window.rowsBetween(Window.unboundedPreceding, -1)


CUTS = 255
PER_RANGE = 4096


def value_ranges(
    counts: DataFrame, keys: Sequence[str], value: str, tallies: Sequence[str]
) -> DataFrame:
    """Adds ``_range`` and ``<tally>_all``: ranges of each key's distinct values, cut at quantiles of
    a mergeable sketch, as many as the number of values needs. Cuts only spread the work, so their
    error changes no result."""
    whole_numbers = isinstance(counts.schema[value].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    kind, cast = ("bigint", "bigint") if whole_numbers else ("double", "double")
    sketch = getattr(F, f"kll_sketch_agg_{kind}")(F.col(value).cast(cast))
    quantiles = getattr(F, f"kll_sketch_get_quantile_{kind}")
    ranges = counts.groupBy(*keys).agg(
        sketch.alias("_sketch"),
        F.least(F.ceil(F.count(F.lit(1)) / PER_RANGE), F.lit(CUTS + 1)).alias("_parts"),
        *[F.sum(t).alias(f"{t}_all") for t in tallies],
    )
    steps = F.array(*[F.lit(i / (CUTS + 1)) for i in range(1, CUTS + 1)])
    # The sketch draws at random: its cuts are stored, so that every reader has the same ones.
    ranges = stored(ranges.withColumn("_cuts", quantiles("_sketch", steps)).drop("_sketch"), "cuts")
    passed = F.size(F.filter("_cuts", lambda cut: cut < F.col(value)))
    return counts.join(ranges, list(keys)).withColumn(
        "_range", F.floor(passed * F.col("_parts") / (CUTS + 1)).cast("int")
    ).drop("_cuts", "_parts")


def running_counts(
    counts: DataFrame, keys: Sequence[str], value: str, tallies: Sequence[str]
) -> DataFrame:
    """Running totals of ``tallies`` over ascending distinct ``value`` per key.

    ``counts`` has one row per key and distinct value. Adds ``<tally>_below`` (rows with a smaller
    value) and ``<tally>_all`` (rows of the key). The values of each key are cut at measured
    quantiles of its distinct values, into as many ranges as their number needs, so that outliers
    don't leave all others in one range and no task sorts all distinct values of a key.
    """
    whole = Window.partitionBy(*keys)
    most = counts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= PER_RANGE:
        before = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        below = {f"{t}_below": F.coalesce(F.sum(t).over(before), F.lit(0)) for t in tallies}
        return counts.withColumns(below | {f"{t}_all": F.sum(t).over(whole) for t in tallies})
    placed = stored(value_ranges(counts, keys, value, tallies), "ranges")
    per_range = placed.groupBy(*keys, "_range").agg(*[F.sum(t).alias(f"_{t}") for t in tallies])
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(f"_{t}").over(earlier), F.lit(0)).alias(f"_{t}_before") for t in tallies],
    )
    inside = (
        Window.partitionBy(*keys, "_range")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    running = placed.select(
        "*", *[F.coalesce(F.sum(t).over(inside), F.lit(0)).alias(f"_{t}_inside") for t in tallies]
    )
    joined = running.join(offsets, [*keys, "_range"])
    below = {f"{t}_below": F.col(f"_{t}_before") + F.col(f"_{t}_inside") for t in tallies}
    helpers = ["_range"]
    helpers += [f"_{t}_{part}" for t in tallies for part in ("before", "inside")]
    return joined.withColumns(below).drop(*helpers)
