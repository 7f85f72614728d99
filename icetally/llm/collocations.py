"""Phrases of two and three words that stand together more often than their parts suggest.

Workers count in a HAT-trie: a shallow trie of word ids whose leaves are hash containers. A first
word's container holds its continuations; when it grows too large it bursts into one container for
each second word. When the trie is full, its largest subtrees are spilled whole, as sorted runs, one
for each prefix partition; a partition's runs from all workers are merged, which gives exact counts.
Ids are those of one worker, so a run brings the words it uses, in byte order. What is frequent is
small and is scored with DataFrame functions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from icetally.llm.alignment import from_planes, planes
from icetally.llm.shared import Scratch, batched, rows

STOPS = b".,;:!?\x0a\x0b\x0c\x0d"
PIECE_END = bytes(ord(".") if c in STOPS else c for c in range(256))
"""Every byte that ends a piece becomes a stop."""

BURST = 1 << 14
"""Continuations that the container of a first word holds before it bursts."""

FULL = 1_300_000
"""Entries of a worker's tries before it spills down to half of them."""

CHUNK = 1 << 19
"""Words of one text that are taken at once."""

SLOT_CHARS = 12 << 20
"""Text whose phrases make about one prefix partition."""

CLASSES = 64
"""Classes of third words, so the phrases of one pair of words are dealt over many partitions."""

RUN = pa.schema(
    [("slot", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("entries", pa.binary())]
)
RUN_DDL = "slot int, lang string, words binary, entries binary"
GRAMS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
GRAMS_DDL = "lang string, size int, phrase string, f long"

BITS = 21


class WordIds(dict):
    """Numbers from 1 for words as they come; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class HatTrie:
    """Counts of word-id triples (0 where a piece has ended)."""

    def __init__(self, burst: int = BURST):
        self.first: dict[int, dict] = {}
        self.burst_nodes: set[int] = set()
        self.sizes: dict[int, int] = {}
        self.size, self.burst = 0, burst

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """``keys`` ascend: three ids of ``BITS`` bits each."""
        word = keys >> (2 * BITS)
        cuts = np.flatnonzero(np.diff(word)) + 1
        rest, times = (keys & ((1 << 2 * BITS) - 1)).tolist(), counts.tolist()
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rest)]):
            one = int(word[s])
            held = self.first.setdefault(one, {})
            if one in self.burst_nodes:
                grown = 0
                for k, n in zip(rest[s:e], times[s:e]):
                    leaf = held.setdefault(k >> BITS, {})
                    grown -= len(leaf)
                    leaf[k & ((1 << BITS) - 1)] = leaf.get(k & ((1 << BITS) - 1), 0) + n
                    grown += len(leaf)
            else:
                grown = -len(held)
                for k, n in zip(rest[s:e], times[s:e]):
                    held[k] = held.get(k, 0) + n
                grown += len(held)
                if len(held) > self.burst:
                    self._burst(one)
            self.sizes[one] = self.sizes.get(one, 0) + grown
            self.size += grown

    def _burst(self, one: int) -> None:
        node: dict[int, dict[int, int]] = {}
        for k, n in self.first[one].items():
            node.setdefault(k >> BITS, {})[k & ((1 << BITS) - 1)] = n
        self.first[one] = node
        self.burst_nodes.add(one)

    def take(self, left: int) -> tuple[np.ndarray, np.ndarray]:
        """Remove whole subtrees, the largest first, until ``left`` entries stay; their sorted keys
        and counts."""
        keys, counts = [], []
        for one in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.size <= left:
                break
            held = self.first.pop(one)
            if one in self.burst_nodes:
                self.burst_nodes.discard(one)
                held = {two << BITS | three: n for two, leaf in held.items() for three, n in leaf.items()}
            keys.append(np.fromiter(held.keys(), np.int64, len(held)) | one << (2 * BITS))
            counts.append(np.fromiter(held.values(), np.int64, len(held)))
            self.size -= self.sizes.pop(one)
        if not keys:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys)
        return keys[order], counts[order]


def phrase_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All phrases of one, two and three words (ids, 0 after the last) of whole subtrees."""
    out, times = [keys[keys & ((1 << BITS) - 1) != 0]], [counts[keys & ((1 << BITS) - 1) != 0]]
    for drop in (BITS, 2 * BITS):
        short = keys >> drop << drop
        if drop == BITS:
            inside = short >> BITS & ((1 << BITS) - 1) != 0
            short, n = short[inside], counts[inside]
        else:
            n = counts
        if len(short):
            starts = np.flatnonzero(np.diff(short, prepend=-1))
            out.append(short[starts])
            times.append(np.add.reduceat(n, starts))
    return np.concatenate(out), np.concatenate(times)


def runs(lang: str, words: list[bytes], keys: np.ndarray, counts: np.ndarray, slots: int) -> Iterator[tuple]:
    """Rows of RUN: the phrases of whole subtrees, sorted by their words, for each partition."""
    keys, counts = phrase_counts(keys, counts)
    if not len(keys):
        return
    mask = (1 << BITS) - 1
    ids = np.stack([keys >> (2 * BITS), keys >> BITS & mask, keys & mask])
    used = np.unique(ids)
    used = used[used > 0]
    order = sorted(used.tolist(), key=words.__getitem__)
    rank = np.zeros(used[-1] + 1, dtype=np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    mark = np.zeros(used[-1] + 1, dtype=np.uint64)
    mark[order] = [zlib.crc32(words[i]) for i in order]
    # A phrase of one word lies with that prefix, one of two or three words with its first two.
    deal = np.uint64(zlib.crc32(lang.encode())) + mark[ids[0]] * np.uint64(0x9E3779B97F4A7C15)
    deal += mark[ids[1]] * np.uint64(0xC2B2AE3D27D4EB4F)
    deal += mark[ids[2]] % np.uint64(CLASSES) * np.uint64(0x165667B19E3779F9)
    slot = (deal >> np.uint64(20)) % np.uint64(slots)
    # Words in byte order within each slot: one sort of the three ranks together, one of the slots.
    ranks = rank[ids]
    by_rank = np.argsort(ranks[0] << (2 * BITS) | ranks[1] << BITS | ranks[2])
    slot = slot[by_rank]
    by_slot = np.argsort(slot.astype(np.uint16) if slots < 1 << 16 else slot, kind="stable")
    slot, by_rank = slot[by_slot], by_rank[by_slot]
    ranks, counts = ranks[:, by_rank], counts[by_rank]
    cuts = np.flatnonzero(np.diff(slot)) + 1
    zstd = zstandard.ZstdCompressor(1)
    place_of = np.zeros(len(order) + 1, dtype=np.int64)
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(slot)]):
        part = ranks[:, s:e]
        there = np.zeros(len(order) + 1, dtype=bool)
        there[part.ravel()] = True
        own = np.flatnonzero(there[1:])
        place_of[own + 1] = np.arange(1, len(own) + 1)
        place = place_of[part]
        listed = b" ".join([words[order[i]] for i in own.tolist()])
        place[0] = np.diff(place[0], prepend=0)
        columns = np.concatenate([place.ravel(), counts[s:e]]).astype("<u8")
        yield int(slot[s]), lang, zstd.compress(listed), zstd.compress(planes(columns))


def count_runs(batches: Iterator[pa.RecordBatch], slots: int, full: int, burst: int, chunk: int) -> Iterator[tuple]:
    """Rows of RUN for the texts of a task."""
    ids, tries, waiting = WordIds({b".": 0}), {}, {}

    def settle(lang: str) -> None:
        keys, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
        if len(keys):
            tries.setdefault(lang, HatTrie(burst)).add(keys, n)

    def spill(left: int) -> Iterator[tuple]:
        words = list(ids)
        for lang in sorted(tries, key=lambda x: -tries[x].size):
            rest = sum(t.size for t in tries.values()) - tries[lang].size
            yield from runs(lang, words, *tries[lang].take(max(0, left - rest)), slots)

    held = 0
    for lang, text in rows(batches, "lang", "text"):
        words = text.lower().translate(PIECE_END).replace(b".", b" . ").split()
        for s in range(0, len(words), chunk):
            part = words[s : s + chunk + 2]
            n = min(chunk, len(part))
            x = np.zeros(len(part) + 2, dtype=np.int64)
            x[: len(part)] = np.fromiter(map(ids.__getitem__, part), np.int64, len(part))
            one, two, three = x[:n], x[1 : n + 1], np.where(x[1 : n + 1] == 0, 0, x[2 : n + 2])
            keys = (one << (2 * BITS) | two << BITS | three)[one != 0]
            waiting.setdefault(lang, []).append(keys)
            held += len(keys)
            crowded = len(ids) + chunk + 2 >= 1 << BITS
            if held >= 2 * chunk or crowded:
                for name in list(waiting):
                    settle(name)
                held = 0
            if crowded:
                yield from spill(0)
                ids, tries = WordIds({b".": 0}), {}
            elif sum(t.size for t in tries.values()) > full:
                yield from spill(full // 2)
    for name in list(waiting):
        settle(name)
    yield from spill(0)


def merged_runs(table: pa.Table, least: int) -> pa.Table:
    """The phrases of one prefix partition with at least ``least`` occurrences, and for each lang a
    row of size 0 with the number of its words."""
    out = []
    zstd = zstandard.ZstdDecompressor()
    langs = table["lang"].to_pylist()
    for lang in sorted(set(langs)):
        own = [i for i, x in enumerate(langs) if x == lang]
        lists = [zstd.decompress(table["words"][i].as_py()).split(b" ") for i in own]
        words = sorted(set().union(*lists))
        place = {w: n for n, w in enumerate(words, 1)}
        width = len(words) + 1
        pairs, thirds, counts = [], [], []
        for i, listed in zip(own, lists):
            columns = from_planes(zstd.decompress(table["entries"][i].as_py()), "<u8").astype(np.int64)
            columns = columns.reshape(4, -1)
            columns[0] = np.cumsum(columns[0])
            at = np.array([0, *map(place.__getitem__, listed)], dtype=np.int64)
            pairs.append(at[columns[0]] * width + at[columns[1]])
            thirds.append(at[columns[2]])
            counts.append(columns[3])
        pairs, thirds, counts = map(np.concatenate, (pairs, thirds, counts))
        if width < 1 << BITS:
            key = pairs * width + thirds
        else:
            key = np.unique(pairs, return_inverse=True)[1] * width + thirds
        order = np.argsort(key, kind="stable")  # a merge: the parts of key are sorted already
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        total = np.add.reduceat(counts[order], starts)
        first = order[starts]
        single = (pairs[first] % width == 0) & (thirds[first] == 0)
        out.append((lang, 0, None, int(total[single].sum())))
        for f, p, three in zip(*(x[total >= least].tolist() for x in (total, pairs[first], thirds[first]))):
            named = [words[i - 1] for i in (p // width, p % width, three) if i]
            out.append((lang, len(named), b" ".join(named).decode("utf-8", "replace"), f))
    return pa.table([pa.array(list(c), t.type) for c, t in zip(zip(*out), GRAMS)], schema=GRAMS)


def frequent_phrases(
    docs: DataFrame, scratch: Scratch, least: int, full: int = FULL, burst: int = BURST,
    chunk: int = CHUNK, slot_chars: int = SLOT_CHARS,
) -> DataFrame:
    """``lang``, ``size``, ``phrase``, ``f``: phrases of one to three words that occur ``least``
    times, counted per lang within pieces, and with size 0 the words of a lang."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), text.cast("binary").alias("text"))
    size = docs.select(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    slots = 1 + size // slot_chars

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(count_runs(batches, slots, full, burst, chunk), RUN, 16)

    dealt = texts.mapInArrow(count, RUN_DDL).groupBy("slot")
    return scratch.write(dealt.applyInArrow(lambda table: merged_runs(table, least), GRAMS_DDL), "grams")


def collocations(
    docs: DataFrame, least: int = 10, share: int = 50, top: int | None = None, **limits: int
) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of phrases of two or three words,
    and with ``top`` only each lang's first ones and their ``rank``.

    Candidates occur ``least`` times. The cut with the lowest floor(1000000 a² / (l r)) counts, the
    first one among equals. A candidate goes if a longer one holds it and has ``share`` percent of
    its occurrences. Null texts are empty, a null lang is ``und``; rows that are alike count each;
    ``lang`` and ``text`` are the only columns read. A table without candidates gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    grams = frequent_phrases(docs, scratch, least, **limits)
    words = grams.where("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    known = grams.where("size > 0")
    found = known.where("size > 1").withColumnRenamed("f", "a")
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    for side, name in (("left", "l"), ("right", "r")):
        part = known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(part, ["lang", side])
    exact = "(1000000BD * cast(a as decimal(15,0)) * a) div (cast(l as decimal(19,0)) * r)"
    scored = cuts.withColumn("score", F.expr(exact))
    best = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a")
    )
    inner = found.where("size = 3").select(
        "lang", F.col("a").alias("longer"),
        F.explode(F.array(*(F.expr(f"substring_index(phrase, ' ', {k})") for k in (2, -2)))).alias("phrase"),
    )
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))
    )
    listed = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    if top is not None:
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        # Each lang's first ones of 64 parts, then of these, so no lang is sorted in one task.
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
        listed = listed.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
        ranked = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
        listed = listed.withColumn("rank", ranked).where(F.col("rank") <= top)
    return listed.join(words, "lang")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    found = collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), top=2000)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
        FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k)
  GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM grams WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT lang, k, phrase, a, c, array_to_string(ws[1:c], ' ') AS head, array_to_string(ws[c + 1:k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, c, p.f AS l, q.f AS r,
    ((1000000::HUGEINT * a * a) // (p.f::HUGEINT * q.f))::BIGINT AS score
  FROM cuts JOIN grams p ON p.lang = cuts.lang AND p.phrase = head AND p.k = c
    JOIN grams q ON q.lang = cuts.lang AND q.phrase = tail AND q.k = cuts.k - c
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inner_phrases AS (
  SELECT lang, a AS longer, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase
  FROM candidates WHERE k = 3
), kept AS (
  SELECT * FROM lowest WHERE NOT EXISTS (SELECT 1 FROM inner_phrases i
    WHERE i.lang = lowest.lang AND i.phrase = lowest.phrase AND 100 * i.longer >= 50 * lowest.a)
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score
FROM kept JOIN totals ON totals.lang = kept.lang QUALIFY rank <= 2000
"""
