"""Benchmark passages in documents, by a prefix-filtered join of word shingles.

A window is a run of consecutive words of a benchmark item. It occurs in a document only if all of
its shingles do, so it is enough to look for one of them: the one that is rarest in the corpus (the
prefix of a set join whose threshold is all shingles). Hits of that shingle are checked against the
bounds of the document and then shingle by shingle, which is exact.

The benchmark is handled in blocks of bounded size, each a stated set of windows that all documents
are searched for; what a worker holds doesn't grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icetally.llm.shared import Scratch, batched, hash128, rows, text_bytes

WINDOW = 10
SHINGLE = 3
BLOCK_WORDS = 500_000
"""Benchmark words that one pass over the documents looks for."""

# Words are runs of bytes other than ASCII characters that are no digit or letter.
_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else (b if b in _KEPT else 0x20) for b in range(256)
)

FOUND = "doc_id long, h1 long, h2 long, n_words long, spans array<struct<first:long,stop:long>>, items array<string>"
HITS_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n_words", pa.int64()),
     ("places", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int32()))]
)
FOUND_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n_words", pa.int64()),
     ("spans", pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))),
     ("items", pa.list_(pa.string()))]
)


def split_words(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class Windows:
    """The windows of a block of items, and the shingles that they are made of."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[list[str]] = []
        numbered: dict[tuple[int, ...], int] = {}
        shingles: dict[tuple[int, ...], int] = {}
        parts: list[list[int]] = []
        self.lengths: list[int] = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for a in range(max(1, len(ids) - window + 1) if ids else 0):
                run = tuple(ids[a : a + window])
                if run not in numbered:
                    numbered[run] = len(parts)
                    width = min(SHINGLE, len(run))
                    cut = [run[t : t + width] for t in range(len(run) - width + 1)]
                    parts.append([shingles.setdefault(s, len(shingles)) for s in cut])
                    self.lengths.append(len(run))
                    self.items.append([])
                if item is not None and item not in self.items[numbered[run]]:
                    self.items[numbered[run]].append(item)
        self.parts = parts
        self.n_shingles = len(shingles)
        self.base = len(self.vocabulary) + 1
        # For each width the sorted keys of its shingles and their numbers.
        self.lookup: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in sorted({len(s) for s in shingles}):
            own = [(self.key(s), n) for s, n in shingles.items() if len(s) == width]
            keys, numbers = np.array(sorted(own), dtype=np.int64).T
            self.lookup[width] = (keys, numbers.astype(np.int32))

    def key(self, shingle: tuple[int, ...]) -> int:
        out = 0
        for word in shingle:
            out = out * self.base + word
        return out

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places (4 x position + width, ascending) and numbers of the shingles that occur."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        places, numbers = [], []
        for width, (keys, own) in self.lookup.items():
            n = len(ids) - width + 1
            if n <= 0:
                continue
            there = ids[:n] > 0
            for t in range(1, width):
                there &= ids[t : n + t] > 0
            at = np.flatnonzero(there)
            key = np.zeros(len(at), dtype=np.int64)
            for t in range(width):
                key = key * self.base + ids[at + t]
            slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            same = keys[slot] == key
            places.append(4 * at[same] + width)
            numbers.append(own[slot[same]])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        place, number = np.concatenate(places), np.concatenate(numbers)
        order = np.argsort(place, kind="stable")
        return place[order], number[order]


class PrefixJoin:
    """Windows by their rarest shingle."""

    def __init__(self, windows: Windows, frequency: np.ndarray):
        rarest = [min(range(len(p)), key=lambda t: (frequency[p[t]], p[t])) for p in windows.parts]
        prefix = np.array([p[t] for p, t in zip(windows.parts, rarest)], dtype=np.int64)
        order = np.argsort(prefix, kind="stable")
        self.window = order
        self.first = np.searchsorted(prefix[order], np.arange(windows.n_shingles + 1))
        self.offset = np.array(rarest, dtype=np.int64)
        self.length = np.array(windows.lengths, dtype=np.int64)
        self.width = np.minimum(SHINGLE, self.length)
        most = max((len(p) for p in windows.parts), default=0)
        self.parts = np.full((len(windows.parts), most), -1, dtype=np.int64)
        for n, p in enumerate(windows.parts):
            self.parts[n, : len(p)] = p
        self.items = windows.items

    def occurrences(
        self, n_words: int, places: np.ndarray, shingles: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of every window that occurs."""
        per_hit = self.first[shingles + 1] - self.first[shingles]
        hit = np.repeat(np.arange(len(shingles)), per_hit)
        nth = np.arange(len(hit)) - np.repeat(np.cumsum(per_hit) - per_hit, per_hit)
        window = self.window[self.first[shingles[hit]] + nth]
        start = places[hit] // 4 - self.offset[window]
        fits = (start >= 0) & (start + self.length[window] <= n_words)
        window, start = window[fits], start[fits]
        for t in range(self.parts.shape[1]):
            part = self.parts[window, t]
            want = 4 * (start + t) + self.width[window]
            slot = np.minimum(np.searchsorted(places, want), len(places) - 1)
            same = (part < 0) | ((places[slot] == want) & (shingles[slot] == part))
            window, start = window[same], start[same]
            if not len(window):
                break
        return start, window


def union(first: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Spans as ascending spans that don't touch."""
    out: list[list[int]] = []
    for a, b in sorted(zip(first.tolist(), stop.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def block_hits(docs: DataFrame, windows: Windows) -> DataFrame:
    """Places of the block's shingles in every whole text."""
    h1, h2 = hash128(F.col("text"))
    found = text_bytes(docs).withColumns({"h1": h1, "h2": h2})

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for doc_id, text, a, b in rows(batches, "doc_id", "text", "h1", "h2"):
                words = split_words(text)
                places, shingles = windows.hits(words)
                yield doc_id, a, b, len(words), places, shingles

        yield from batched(records(), HITS_ARROW, 500)

    return found.mapInArrow(
        take,
        "doc_id long, h1 long, h2 long, n_words long, places array<long>, shingles array<int>",
    )


def block_spans(hits: DataFrame, join: PrefixJoin) -> DataFrame:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            names = [f.name for f in HITS_ARROW]
            for doc_id, a, b, n_words, places, shingles in rows(batches, *names):
                spans, items = [], set()
                if places:
                    start, window = join.occurrences(
                        n_words, np.array(places, np.int64), np.array(shingles, np.int64)
                    )
                    spans = union(start, start + join.length[window])
                    items = {i for w in set(window.tolist()) for i in join.items[w]}
                yield doc_id, a, b, n_words, [{"first": x, "stop": y} for x, y in spans], sorted(items)

        yield from batched(records(), FOUND_ARROW, 500)

    return hits.mapInArrow(verify, FOUND)


def benchmark_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """Items with their words, in blocks. The driver holds one block at a time."""
    block, held = [], 0
    items = benchmark.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit("")).cast("binary"))
    for item, text in items.toLocalIterator():
        words = split_words(bytes(text))
        block.append((item, words))
        held += len(words)
        if held >= block_words:
            yield block
            block, held = [], 0
    yield block


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``doc_id``, ``h1`` and ``h2`` (hash of the text), ``n_words``, ``spans`` (word positions that
    a window covers), ``items``.

    One row for each row of ``docs``. Null texts have no words; an item with fewer words than a
    window is one window, one without words none; an item without id covers words and is named
    nowhere. An empty table of documents gives no rows, an empty benchmark finds nothing.
    """
    scratch = Scratch(docs.sparkSession)
    parts = []
    for n, block in enumerate(benchmark_blocks(benchmark, block_words)):
        windows = Windows(block, window)
        hits = scratch.write(block_hits(docs, windows), f"hits-{n}")
        counted = hits.select(F.explode("shingles").alias("s")).groupBy("s").count()
        # A number for each shingle of the block.
        frequency = np.zeros(windows.n_shingles + 1, dtype=np.int64)
        for s, count in counted.collect():
            frequency[s] = count
        parts.append(scratch.write(block_spans(hits, PrefixJoin(windows, frequency)), f"found-{n}"))
        scratch.drop(f"hits-{n}")
    key = ["doc_id", "h1", "h2", "n_words"]
    if len(parts) == 1:
        return parts[0].select(*key, "spans", "items")
    # Rows that are alike have alike results in each block: merge them once, then repeat them.
    times = parts[0].groupBy(*key).agg(F.count("*").alias("times"))
    every = parts[0].select(*key, "spans", "items", F.lit(0).alias("block"))
    for n, part in enumerate(parts[1:], 1):
        every = every.unionAll(part.select(*key, "spans", "items", F.lit(n).alias("block")))
    merged = every.dropDuplicates([*key, "block"]).groupBy(*key).agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    same = [merged[k].eqNullSafe(times[k]) for k in key]
    repeated = merged.join(times, same).select(
        *[merged[k] for k in key], "spans", "items", F.explode(F.sequence(F.lit(1), "times"))
    )
    return repeated.select(*key, joined_spans().alias("spans"), "items")


def joined_spans():
    """Sorted spans, with those that touch made one."""
    return F.expr(
        "aggregate(spans, cast(array() as array<struct<first:long,stop:long>>), (done, s) ->"
        " if(size(done) > 0 and s.first <= element_at(done, -1).stop,"
        " concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first,"
        " 'stop', greatest(s.stop, element_at(done, -1).stop)))), concat(done, array(s))))"
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs."""
    found = contamination(docs, benchmark).where("size(spans) > 0")
    found = found.select("doc_id", "h1", "h2").distinct()
    h1, h2 = hash128(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (h1 == found["h1"]) & (h2 == found["h2"])
    return docs.join(found, same, "left_anti")


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
