"""Repeated word windows, found by anchors at difference-cover positions.

The cover D modulo a period v has, for any two positions i and j, a shift below v that takes both
to cover positions. So two equal windows of at least v + a - 1 words have an aligned anchor of a
words in common, and hashes are needed at cover positions only (6 of 31). Documents are extended
around the anchors that they share with others: only windows that hold such an anchor are hashed
in full, with 128 bits, and compared.

Texts are stored once, bucketed by row, so that the later steps join them without moving them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icetally.llm.shared import Scratch, batched, rows, text_bytes

WINDOW = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
"""Every difference modulo 31 is one of two members."""

MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NO_ID = 2**63 - 1
"""Orders rows without id behind all others."""

TEXTS = "uid long, doc_id long, n_words long, h1 long, h2 long, sha string, packed binary"
TEXTS_ARROW = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("h1", pa.int64()),
     ("h2", pa.int64()), ("sha", pa.string()), ("packed", pa.binary())]
)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class Rolling:
    """Polynomial hashes of all windows of a length, modulo 2**64, without a loop over words."""

    def __init__(self, multiplier: int):
        self.multiplier, self.inverse = multiplier, pow(multiplier, -1, 1 << 64)
        self.powers = self.back = np.ones(1, dtype=np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(values):
            n = 2 * len(values)
            up, down = np.full(n, self.multiplier, np.uint64), np.full(n, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self.powers, self.back = np.multiply.accumulate(up), np.multiply.accumulate(down)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def at(self, sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        return (sums[starts + length] - sums[starts]) * self.back[starts]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh64_intdigest, words)), dtype=np.uint64)


def second(values: np.ndarray) -> np.ndarray:
    """Other hashes of the same words."""
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def cover_positions(n: int) -> np.ndarray:
    at = (np.arange(0, n + PERIOD, PERIOD)[:, None] + np.array(COVER)).ravel()
    return at[at < n]


def stored_texts(docs: DataFrame, scratch: Scratch, buckets: int) -> str:
    """Write one row per document to a table bucketed by row; returns the table's name."""
    numbered = text_bytes(docs).withColumn("uid", F.monotonically_increasing_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)

        def records() -> Iterator[tuple]:
            for uid, doc_id, text in rows(batches, "uid", "doc_id", "text"):
                words = text.split()
                joined = b" ".join(words)
                h1 = signed(xxhash.xxh64_intdigest(joined, 1))
                h2 = signed(xxhash.xxh64_intdigest(joined, 2))
                sha = hashlib.sha256(joined).hexdigest()
                yield uid, doc_id, len(words), h1, h2, sha, packer.compress(joined)

        yield from batched(records(), TEXTS_ARROW, 500)

    table = f"llm_texts_{uuid.uuid4().hex}"
    spread = numbered.mapInArrow(pack, TEXTS).repartition(buckets, "uid")
    spread.write.option("path", scratch.path("texts")).option("compression", "none").bucketBy(
        buckets, "uid"
    ).saveAsTable(table)
    return table


def unpacked(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split() if packed else []


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where each different key stands first, ascending."""
    order = np.lexsort((np.arange(len(keys[0])), *keys))
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return np.sort(order[new])


class Columns:
    """Collects numpy columns and gives them out as record batches of some 100,000 rows."""

    def __init__(self, *names: str):
        self.names, self.held, self.size = names, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.held.append(columns)
        self.size += len(columns[0])

    def take(self, least: int = 100_000) -> Iterator[pa.RecordBatch]:
        if self.size >= max(least, 1):
            columns = [np.concatenate(c) for c in zip(*self.held)]
            self.held, self.size = [], 0
            for a in range(0, len(columns[0]), 200_000):
                part = [pa.array(c[a : a + 200_000]) for c in columns]
                yield pa.RecordBatch.from_arrays(part, names=list(self.names))


def anchor_rows(texts: DataFrame, window: int) -> DataFrame:
    """``anchor``, ``ord`` (the document's place in the order of ids), ``uid``, ``pos``: the first
    position of each anchor in a document, however often the document repeats it."""
    length = window - PERIOD + 1

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, out = Rolling(MULTIPLIERS[0]), Columns("anchor", "ord", "uid", "pos")
        for uid, ord_, packed in rows(batches, "uid", "ord", "packed"):
            values = word_hashes(unpacked(packed))
            at = cover_positions(len(values) - length + 1)
            hashes = rolling.at(rolling.sums(values), at, length).view(np.int64)
            once = firsts(hashes)
            hashes, at = hashes[once], at[once]
            same = np.full(len(at), ord_, np.int64), np.full(len(at), uid, np.int64)
            out.add(hashes, *same, at.astype(np.int64))
            yield from out.take()
        yield from out.take(1)

    chosen = texts.where(f"n_words >= {window}").select("uid", "ord", "packed")
    return chosen.mapInArrow(take, "anchor long, ord long, uid long, pos long")


def runs(
    batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], later_only: bool
) -> Iterator[pa.RecordBatch]:
    """Rows (``uid``, ``pos``) of a stream sorted by key and ``ord`` whose key two ``ord`` share.

    With ``later_only`` those of the smallest ``ord`` are left out. Only the rows of the smallest
    ``ord`` of the key at a batch's end are held.
    """
    key, first, known, waiting = None, None, False, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        ords, uids, places = (
            batch.column(k).to_numpy(zero_copy_only=False) for k in ("ord", "uid", "pos")
        )
        change = np.zeros(len(ords), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        goes_on = key is not None and all(c[0] == k for c, k in zip(columns, key))
        starts, run = np.concatenate(([0], np.flatnonzero(change))), np.cumsum(change)
        low = ords[starts].copy()
        if goes_on:
            low[0] = first
        later = ords > low[run]
        shared = np.zeros(len(starts), bool)
        shared[run[later]] = True
        if goes_on and known:
            shared[0] = True
        kept = later if later_only else shared[run]
        out = [(uids[kept], places[kept])]
        if goes_on and shared[0]:
            out += waiting
        if not goes_on or len(starts) > 1 or shared[0]:
            waiting = []
        if not later_only and not shared[-1]:
            waiting.append((uids[starts[-1] :], places[starts[-1] :]))
        key, first, known = tuple(c[-1] for c in columns), low[-1], bool(shared[-1])
        found = [np.concatenate(c) for c in zip(*out)]
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["uid", "pos"])


def shared_rows(frame: DataFrame, keys: tuple[str, ...], later_only: bool) -> DataFrame:
    """A key has one row for each document that has it, so it is a small part of the rows even if
    all documents have it; sorted runs stream through, whatever their length."""
    spread = frame.repartition(*keys).sortWithinPartitions(*keys, "ord")
    found = spread.mapInArrow(lambda b: runs(b, keys, later_only), "uid long, pos long")
    return found.groupBy("uid").agg(F.collect_list("pos").alias("places"))


def window_rows(texts: DataFrame, window: int) -> DataFrame:
    """Windows that hold a shared anchor: ``k1``, ``k2``, ``ord``, ``uid``, ``pos``, the first of
    equal ones in a document."""
    length = window - PERIOD + 1

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Rolling(MULTIPLIERS[0]), Rolling(MULTIPLIERS[1])
        out = Columns("k1", "k2", "ord", "uid", "pos")
        for uid, ord_, packed, places in rows(batches, "uid", "ord", "packed", "places"):
            values = word_hashes(unpacked(packed))
            edge = np.zeros(len(values) + 2, dtype=np.int64)
            sums = one.sums(values)
            covered = cover_positions(len(values) - length + 1)
            anchors = one.at(sums, covered, length)
            at = covered[np.isin(anchors, one.at(sums, np.array(places, dtype=np.int64), length))]
            np.add.at(edge, np.maximum(at - PERIOD + 1, 0), 1)
            np.add.at(edge, at + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge)[: len(values) - window + 1] > 0)
            k1 = one.at(sums, starts, window).view(np.int64)
            k2 = two.at(two.sums(second(values)), starts, window).view(np.int64)
            once = firsts(k1, k2)
            k1, k2, starts = k1[once], k2[once], starts[once]
            same = np.full(len(starts), ord_, np.int64), np.full(len(starts), uid, np.int64)
            out.add(k1, k2, *same, starts)
            yield from out.take()
        yield from out.take(1)

    return texts.select("uid", "ord", "packed", "places").mapInArrow(
        take, "k1 long, k2 long, ord long, uid long, pos long"
    )


def removed_rows(texts: DataFrame, window: int) -> DataFrame:
    """``uid``, ``n_removed``, ``kept_sha256`` and ``spans`` of the rows with repeated windows."""
    schema = pa.schema(
        [("uid", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
         ("spans", pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())])))]
    )

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Rolling(MULTIPLIERS[0]), Rolling(MULTIPLIERS[1])

        def records() -> Iterator[tuple]:
            for uid, packed, places in rows(batches, "uid", "packed", "places"):
                words = unpacked(packed)
                values = word_hashes(words)
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                # The windows of the document that are equal to those found.
                starts, found = np.arange(len(words) - window + 1), np.array(places, dtype=np.int64)
                k1 = one.at(one.sums(values), starts, window)
                k2 = two.at(two.sums(second(values)), starts, window)
                at = starts[np.isin(k1, k1[found]) & np.isin(k2, k2[found])]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                spans = [{"first": int(a), "stop": int(b)} for a, b in turns.reshape(-1, 2)]
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                yield uid, int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans

        yield from batched(records(), schema, 500)

    return texts.select("uid", "packed", "places").mapInArrow(
        take,
        "uid long, n_removed long, kept_sha256 string, spans array<struct<first:long,stop:long>>",
    )


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words covered by a window that also starts in a document with a smaller id.

    One row for each row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of
    the words left, joined by blanks) and ``spans`` (word positions removed). Null and empty texts
    have no words. Rows that share an id are not copies of each other; rows without id come
    after all ids and remove nothing from each other. Other columns are ignored.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = stored_texts(docs, scratch, buckets)
    texts = spark.table(table).withColumn("ord", F.coalesce("doc_id", F.lit(NO_ID)))
    # Texts that are equal word by word are one class; its first row stands for it.
    named = texts.select("uid", "ord", "n_words", "h1", "h2")
    first = scratch.write(
        named.groupBy("n_words", "h1", "h2").agg(F.min(F.struct("ord", "uid")).alias("head")),
        "classes",
    )
    heads = first.select(F.col("head.uid").alias("uid"))
    bodies = texts.join(heads, "uid")
    shared = scratch.write(shared_rows(anchor_rows(bodies, window), ("anchor",), False), "shared")
    near = texts.join(shared, "uid")
    later = scratch.write(shared_rows(window_rows(near, window), ("k1", "k2"), True), "later")
    gone = scratch.write(removed_rows(texts.join(later, "uid"), window), "gone")
    summary = scratch.write(texts.select("doc_id", "ord", "n_words", "h1", "h2", "sha"), "summary")
    spark.sql(f"DROP TABLE {table}")
    scratch.drop("shared", "later", "texts")
    by_class = scratch.write(
        first.join(gone, F.col("head.uid") == gone["uid"], "left").select(
            "n_words", "h1", "h2", F.col("head.ord").alias("low"), "n_removed", "kept_sha256", "spans"
        ),
        "by-class",
    )
    copy = (F.col("ord") > F.col("low")) & (F.col("n_words") >= window)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("stop")))
    nothing = F.expr("cast(array() as array<struct<first:long,stop:long>>)")
    return summary.join(by_class, ["n_words", "h1", "h2"]).select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256))
        .otherwise(F.coalesce("kept_sha256", "sha"))
        .alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", nothing)).alias("spans"),
    )


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
