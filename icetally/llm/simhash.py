"""SimHash near-duplicates, compared in bit slices.

Equal fingerprints are one class first. Two different ones within the radius agree in at least two
of five segments, so every class stands under ten keys, and only classes with a key in common are
compared. The comparison keeps bit planes: bit b of 64 fingerprints is one word, distances to all 64
are counted by carry-save adders on such words, and a word is left as soon as all its 64 distances
exceed the radius. Keys with many classes are cut into chunks and compared chunk against chunk.
Only a spanning star of the links of a block is sent on, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icetally.llm.shared import Scratch, batched, components, rows, text_bytes

SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
"""First bit and width of the five segments."""

CHUNK = 512
"""Classes of a key that are compared as one side of a block."""

STREAM = 1 << 15
"""Fingerprints that a worker compares at once, and at least one whole block."""


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64 bits by majority over the XXH64 of all word shingles; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - width + 1)
    firsts, lasts = starts[:n], ends[len(words) - n :] - 1
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 1 << 16):
        cut = [joined[s:e] for s, e in zip(firsts[a : a + 65536].tolist(), lasts[a : a + 65536].tolist())]
        hashes = np.array(list(map(xxhash.xxh64_intdigest, cut, repeat(seed))), dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) of whole texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for doc_id, text in rows(batches, "doc_id", "text"):
                bits = fingerprint(text)
                yield doc_id, bits - (1 << 64) if bits >> 63 else bits

        yield from batched(records(), schema)

    return text_bytes(docs).mapInArrow(take, "doc_id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Plane b, word w: bit b of the fingerprints 64 w to 64 w + 63."""
    lanes = -(-len(fps) // 64)
    padded = np.zeros(64 * lanes, dtype="<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), bitorder="little").reshape(lanes, 64, 64)
    turned = np.ascontiguousarray(bits.transpose(2, 0, 1))
    return np.packbits(turned, axis=2, bitorder="little").view("<u8").reshape(64, lanes)


def close_pairs(
    fps: np.ndarray, block: np.ndarray, radius: int = 3
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of the same block (blocks are contiguous) that differ in few bits.

    A counter has two bits and a sticky overflow, which is a distance over 3.
    """
    if radius > 3:
        raise ValueError("the counters hold distances up to 3")
    n = len(fps)
    stops = np.searchsorted(block, block, side="right")
    planes = bit_planes(fps)
    at = np.arange(n)
    first, last = (at + 1) // 64, (stops - 1) // 64
    words = np.where(stops - at > 1, last - first + 1, 0)
    query = np.repeat(at, words)
    word = np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words) + first[query]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    # Lanes before the query or past its block count as too far from the start.
    low = np.clip(query + 1 - 64 * word, 0, 63).astype(np.uint64)
    high = np.clip(64 * word + 64 - stops[query], 0, 63).astype(np.uint64)
    over = ~((full << low) & (full >> high))
    one, two = np.zeros_like(over), np.zeros_like(over)
    for b in range(64):
        mine = (fps[query] >> np.uint64(b)) & np.uint64(1)
        differ = planes[b][word] ^ (np.uint64(0) - mine)
        carry = one & differ
        one ^= differ
        over |= two & carry
        two ^= carry
        if b % 8 == 7 and len(query):
            left = over != full
            if left.mean() < 0.75:
                query, word, one, two, over = (x[left] for x in (query, word, one, two, over))
    if radius < 3:
        for lower in range(radius + 1, 4):
            same_one = one if lower & 1 else ~one
            over |= same_one & (two if lower & 2 else ~two)
    hit = ~over
    found = np.flatnonzero(hit)
    lanes = np.unpackbits(hit[found].view(np.uint8), bitorder="little").reshape(-1, 64)
    which, lane = np.nonzero(lanes)
    return query[found][which], 64 * word[found][which] + lane


def stars(n: int, left: np.ndarray, right: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest name that the links reach."""
    low = names.copy()
    while True:
        before = low.copy()
        least = np.minimum(low[left], low[right])
        np.minimum.at(low, left, least)
        np.minimum.at(low, right, least)
        if (low == before).all():
            return low


def block_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links (a: name, b: smallest name reached) of a stream that is sorted by block."""
    held: list[tuple[np.ndarray, ...]] = []

    def compare(parts: tuple[np.ndarray, ...]) -> pa.RecordBatch | None:
        key, left, right, fps, names = parts
        change = np.ones(len(key), dtype=np.int64)
        change[1:] = (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        block = np.cumsum(change)
        i, j = close_pairs(fps.view("<u8"), block, radius)
        if not len(i):
            return None
        low = stars(len(key), i, j, names)
        ends = np.unique(np.concatenate((i, j)))
        ends = ends[low[ends] != names[ends]]
        pairs = np.unique(np.stack((names[ends], low[ends]), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def joined() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(c) for c in zip(*held))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "i", "j", "fp", "name")))
        if sum(len(h[0]) for h in held) < STREAM:
            continue
        parts = joined()
        # The last block may go on in the next batch.
        key, left, right = parts[:3]
        open_ = (key == key[-1]) & (left == left[-1]) & (right == right[-1])
        cut = len(key) - int(open_.sum())
        if cut:
            found = compare(tuple(p[:cut] for p in parts))
            if found is not None:
                yield found
        held = [tuple(p[cut:] for p in parts)]
    if held:
        found = compare(joined())
        if found is not None:
            yield found


def segment_keys() -> Column:
    """Ten keys: the bits of two segments, with the number of the choice above them."""

    def bits(segment: tuple[int, int]) -> Column:
        first, width = segment
        return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))

    return F.array(
        *[
            F.lit(n).cast("long") * F.lit(1 << 26).cast("long")
            + bits(a) * F.lit(1 << 13).cast("long")
            + bits(b)
            for n, (a, b) in enumerate(combinations(SEGMENTS, 2))
        ]
    )


def class_links(classes: DataFrame, scratch: Scratch, radius: int = 3) -> DataFrame:
    """Spanning links (a, b) between the names of fingerprint classes (``fp``, ``name``)."""
    keyed = classes.select("fp", "name", F.explode(segment_keys()).alias("key"))
    sizes = scratch.write(
        keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-sizes"
    )
    keyed = scratch.write(keyed, "keyed")
    member = keyed.join(sizes, "key").withColumn(
        "chunks", F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")
    )
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # With several chunks, a chunk meets every other one; its own pairs are in each such block.
    partner = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
        F.array_except(F.sequence(F.lit(0), F.col("chunks") - 1), F.array("mine"))
    )
    blocks = member.withColumn("mine", mine).withColumn("partner", F.explode(partner))
    blocks = blocks.select(
        "key", F.least("mine", "partner").alias("i"), F.greatest("mine", "partner").alias("j"), "fp", "name"
    )
    spread = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = spread.mapInArrow(lambda batches: block_links(batches, radius), "a long, b long")
    return scratch.write(links, "links")


def groups(docs: DataFrame, radius: int = 3) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (smallest ``doc_id`` reachable by links).

    Links join fingerprints that differ in at most ``radius`` (up to 3) bits. Null and empty texts
    have fingerprint zero and link like any other. Rows that share a ``doc_id`` are one node and
    each come back. A row without ``doc_id`` takes the component of the ids with its fingerprint,
    null if there is none, and links nothing. An empty table gives no rows; other columns of
    the table are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(fingerprints(docs), "fingerprints")
    named = found.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("name"))
    classes = scratch.write(named, "classes")
    # One id may have several texts: its classes belong together.
    shared = found.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("fp").alias("low"), F.max("fp").alias("high")
    )
    repeated = shared.where("low <> high").select("doc_id")
    same = found.join(repeated, "doc_id", "left_semi").join(classes, "fp")
    links = class_links(classes, scratch, radius).union(
        same.select(F.col("doc_id").alias("a"), F.col("name").alias("b"))
    )
    roots = components(links, scratch, "roots")
    placed = scratch.write(
        classes.join(roots, classes["name"] == roots["node"], "left").select(
            "fp", F.coalesce("root", "name").alias("component_id")
        ),
        "placed",
    )
    return found.join(placed, "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of their group; one row if that id
    is repeated. Rows without id are no part of a group and stay."""
    found = groups(docs, radius)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    order = Window.partitionBy("__id").orderBy(F.xxhash64("row.text"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("__id"))
    first = whole.join(kept.withColumnRenamed("doc_id", "__id"), "__id").withColumn(
        "nth", F.row_number().over(order)
    )
    single = first.where("nth = 1").select("row.*")
    return single.unionByName(docs.where("doc_id is null"))


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
