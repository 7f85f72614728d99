"""Pack token sequences by patterns of lengths.

Few-document patterns that fill a sequence are enumerated over the lengths that occur, their repeat
counts are fitted to the histogram of lengths by non-negative least squares and rounded, and what
is left is packed best-fit, longest first. All of that works on the histogram, whose size is the
sequence length, whatever the number of documents; the pieces themselves are tokenised once and
looked up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from icetally.llm.shared import Scratch, batched, rows, text_bytes
from icetally.llm.tokens import Encoder

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, block int, nth long"
)
PIECES_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
     ("ids_crc32", pa.int64()), ("block", pa.int32()), ("nth", pa.int64())]
)

Entry = tuple[int, tuple[tuple[int, int], ...]]
"""A number of sequences, and the (length, how many) that each of them holds."""


def patterns(lengths: list[int], capacity: int, partners: int = 12) -> list[tuple[int, ...]]:
    """Pairs and triples of occurring lengths that fill a sequence exactly.

    Each length gets at most ``partners`` second lengths, spread over those that occur.
    """
    there, found = set(lengths), set()
    for a in lengths:
        if capacity - a in there:
            found.add(tuple(sorted((a, capacity - a))))
        fitting = lengths[: bisect_left(lengths, capacity - a)]
        step = max(1, len(fitting) // partners)
        for b in fitting[a % step :: step]:
            if capacity - a - b in there:
                found.add(tuple(sorted((a, b, capacity - a - b))))
    return sorted(found)


def repeat_counts(
    found: list[tuple[int, ...]], counts: dict[int, int], sweeps: int = 8
) -> list[float]:
    """Non-negative least squares of the pattern repeats against the histogram.

    Coordinate descent: each repeat count in turn takes its best value, never below zero.
    """
    left = {length: float(n) for length, n in counts.items()}
    uses = [[(length, p.count(length)) for length in set(p)] for p in found]
    norms = [sum(k * k for _, k in u) for u in uses]
    x = [0.0] * len(found)
    for _ in range(sweeps):
        for i, use in enumerate(uses):
            gain = 0.0
            for length, k in use:
                gain += k * left[length]
            new = x[i] + gain / norms[i]
            if new < 0.0:
                new = 0.0
            delta = new - x[i]
            if delta:
                x[i] = new
                for length, k in use:
                    left[length] -= k * delta
    return x


def best_fit(counts: dict[int, int], capacity: int) -> list[Entry]:
    """Pack a histogram longest first, each into the fullest sequence that still has room.

    Sequences with the same content are one group, so the work follows the number of different
    lengths, not of documents.
    """
    spaces: list[int] = []
    groups: dict[int, list[Entry]] = {}

    def put(space: int, entry: Entry) -> None:
        if space not in groups:
            spaces.insert(bisect_left(spaces, space), space)
            groups[space] = []
        groups[space].append(entry)

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                bins, held = groups[space].pop()
                if not groups[space]:
                    del groups[space], spaces[at]
            else:
                space, bins, held = capacity, n, ()
            each = min(space // length, n)
            full = min(bins, n // each)
            put(space - each * length, (full, (*held, (length, each))))
            n -= full * each
            if bins > full and at is not None and held:
                put(space, (bins - full, held))
            elif bins > full and n:
                # New sequences are opened as needed: the rest of this length shares one.
                put(space - n * length, (1, ((length, n),)))
                n = 0
    return [entry for space in spaces for entry in groups[space]]


def plan(counts: dict[int, int], capacity: int) -> list[Entry]:
    """All sequences for a histogram of lengths: fitted patterns first, then the residual.

    Where only few lengths occur, patterns that fill sequences can leave a residual that doesn't
    pack, so smaller shares of the fitted counts are tried too, and the fewest sequences win.
    """
    there = {length: n for length, n in counts.items() if n}
    whole: list[Entry] = []
    if capacity in there:
        whole.append((there.pop(capacity), ((capacity, 1),)))
    found = patterns(sorted(there), capacity)
    fitted = repeat_counts(found, there)
    order = sorted(range(len(found)), key=lambda i: -fitted[i])

    def rounded(share: float) -> list[Entry]:
        left, out = dict(there), []
        for i in order:
            use = [(n, found[i].count(n)) for n in sorted(set(found[i]), reverse=True)]
            n = min([round(share * fitted[i]), *(left[length] // k for length, k in use)])
            if n > 0:
                out.append((n, tuple(use)))
                for length, k in use:
                    left[length] -= n * k
        return out + best_fit({length: n for length, n in left.items() if n}, capacity)

    tried = [rounded(share) for share in (1.0, 0.75, 0.5, 0.25, 0.0)]
    return whole + min(tried, key=lambda entries: sum(bins for bins, _ in entries))


class Slots:
    """Where the n-th piece of a length goes. Sorted arrays, a few for each length."""

    def __init__(self, entries: list[Entry]):
        taken: dict[int, int] = {}
        slots, base = [], 0
        for bins, use in entries:
            offset = 0
            for length, each in use:
                slots.append((length, taken.get(length, 0), each, base, offset))
                taken[length] = taken.get(length, 0) + bins * each
                offset += length * each
            base += bins
        slots.sort()
        self.table = np.array(slots, dtype=np.int64).reshape(-1, 5)
        self.keys = (self.table[:, 0] << 48) + self.table[:, 1]

    def place(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.table[np.searchsorted(self.keys, (length << 48) + nth, side="right") - 1]
        at = nth - row[:, 1]
        return row[:, 3] + at // row[:, 2], row[:, 4] + at % row[:, 2] * length


def pieces(docs: DataFrame, vocabulary: str, capacity: int, separator: int) -> DataFrame:
    """Tokenise whole texts and cut them; ``nth`` counts the pieces of a length in a task."""
    end = np.array([separator], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block = Encoder.of(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)

        def records() -> Iterator[tuple]:
            for doc_id, text in rows(batches, "doc_id", "text"):
                ids = encoder.encode(text.decode()) + end
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, capacity)):
                    length = min(capacity, total - start)
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    yield doc_id, piece, start, length, crc, block, int(seen[length])
                    seen[length] += 1

        yield from batched(records(), PIECES_ARROW)

    return text_bytes(docs).mapInArrow(cut, PIECES)


def pack(
    docs: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    capacity: int = 2048,
    separator: int = 0,
) -> DataFrame:
    """Pack the documents (``doc_id``, ``text``; others are ignored) into full sequences.

    One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``. A null or empty text is the separator alone. Rows that share an
    id, or have none, are packed each by itself. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cut = scratch.write(pieces(docs, vocabulary, capacity, separator), "pieces")
    blocks = cut.groupBy("length", "block").agg(F.count("*").alias("n"))
    # At most one row for each length and task; numbers the tasks' pieces one after the other.
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    blocks = scratch.write(
        blocks.select("length", "block", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")),
        "blocks",
    )
    # The histogram has at most `capacity` rows.
    histogram = {r[0]: r[1] for r in blocks.groupBy("length").agg(F.sum("n")).collect()}
    slots = Slots(plan(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            nth = batch.column("nth").to_numpy(zero_copy_only=False)
            sequence, offset = slots.place(length, nth)
            kept = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    numbered = cut.join(blocks.drop("n"), ["length", "block"]).withColumn(
        "nth", F.col("nth") + F.col("before")
    )
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "nth").mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long,"
        " sequence_id long, offset long",
    )


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
