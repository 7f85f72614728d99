"""Personal data by fixed patterns, extended by bootstrapped contexts.

The fixed patterns give the seeds. The words around seeds are lexical patterns; a graph of all
mentions, seeds and look-alikes that the fixed patterns miss, joins instances with the patterns
that they occur in. Confidence goes back and forth in Spark: a pattern is as good as its instances
and an instance as good as its patterns together, and look-alikes that confident patterns
agree on are added. Those are seeds of the next generation, whose patterns find more, until a
generation adds nothing. The fixed matches always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icetally.llm.shared import Scratch, batched, rows, text_bytes

KINDS = ("email", "ip", "card", "phone")

AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that the address before didn't take has to be seen from its first digit only.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

NUMBER_LIKE = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9])+")
ADDRESS_LIKE = re.compile(r"\s?(?:[\[(]at[\])]|@)\s?[A-Za-z0-9-]+(?:\s?(?:[\[(]dot[\])]|\.)\s?[A-Za-z0-9-]+)*")
AT_SIGN = re.compile(r"[\[(]at[\])]|@")

SUPPORT = 3
"""Different seeds that a context must have been seen with to be a pattern."""
ROUNDS = 3
CONFIDENCE = 0.9
DOUBT = 0.5
"""Added to a pattern's number of instances, so that few seeds don't make it certain."""

FOUND_ARROW = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()),
     ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))),
     ("mentions", pa.list_(pa.struct([
         ("start", pa.int64()), ("stop", pa.int64()), ("instance", pa.int64()), ("seed", pa.int32()),
         ("could_be", pa.list_(pa.int32())), ("contexts", pa.list_(pa.int64()))])))]
)
FOUND = (
    "uid long, doc_id long, base array<struct<start:long,kind:int,stop:long>>, mentions array<"
    "struct<start:long,stop:long,instance:long,seed:int,could_be:array<int>,contexts:array<long>>>"
)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with what may stand before it; the same as a search from every position."""
    done = 0
    at = text.find("@")
    while at >= 0:
        tail = AFTER_AT.match(text, at)
        start = at
        if tail:
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                done = tail.end()
                yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """Matches of the fixed patterns as (start, kind, stop), in that order."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def look_alikes(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Numbers and addresses that no fixed pattern covers, with the kinds that they could be."""
    starts = sorted(a for a, _, _ in taken)
    reach = list(accumulate((b for _, _, b in sorted(taken)), max))

    def is_free(a: int, b: int) -> bool:
        before = bisect_left(starts, b)
        return not before or reach[before - 1] <= a

    for m in NUMBER_LIKE.finditer(text):
        n = len(digits_of(m.group())) if m.end() - m.start() >= 7 else 0
        could_be = [2] * (12 <= n <= 19) + [3] * (7 <= n <= 15)
        if could_be and is_free(m.start(), m.end()):
            yield m.start(), m.end(), could_be
    for at in AT_SIGN.finditer(text):
        left = at.start()
        if left and text[left - 1] == " ":
            left -= 1
        start = left
        while start and text[start - 1] in LOCAL:
            start -= 1
        tail = ADDRESS_LIKE.match(text, left)
        if tail and start < left and is_free(start, tail.end()):
            yield start, tail.end(), [0]


def context_words(text: str) -> list[str]:
    return [w for w in (x.strip(".,;:!?\"'()[]").lower() for x in text.split()) if w]


def contexts_of(text: str, start: int, stop: int) -> list[int]:
    """Hashes of the lexical patterns around a mention: two words before, one on each side, and
    two words after. A context is at most 80 characters wide."""
    before = context_words(text[max(0, start - 80) : start])[-2:]
    after = context_words(text[stop : stop + 80])[:2]
    out = []
    if len(before) == 2:
        out.append(("before", *before))
    if before and after:
        out.append(("around", before[-1], after[0]))
    if len(after) == 2:
        out.append(("after", *after))
    return [xxhash.xxh64_intdigest("\0".join(c)) - (1 << 63) for c in out]


def instance_of(text: str) -> int:
    kept = "".join(c for c in text.lower() if c.isalnum())
    return xxhash.xxh64_intdigest(kept) - (1 << 63)


def found_rows(docs: DataFrame) -> DataFrame:
    numbered = text_bytes(docs).withColumn("uid", F.monotonically_increasing_id())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for uid, doc_id, raw in rows(batches, "uid", "doc_id", "text"):
                text = raw.decode()
                base = fixed_spans(text)
                mentions = [(a, b, kind, [kind]) for a, kind, b in base]
                mentions += [(a, b, -1, could_be) for a, b, could_be in look_alikes(text, base)]
                yield (
                    uid,
                    doc_id,
                    [{"start": a, "kind": kind, "stop": b} for a, kind, b in base],
                    [
                        {"start": a, "stop": b, "instance": instance_of(text[a:b]), "seed": kind,
                         "could_be": could_be, "contexts": contexts_of(text, a, b)}
                        for a, b, kind, could_be in mentions
                    ],
                )

        yield from batched(records(), FOUND_ARROW, 500)

    return numbered.mapInArrow(find, FOUND)


def generation(edges: DataFrame, known: DataFrame, scratch: Scratch, number: int, rounds: int) -> DataFrame:
    """(``instance``, ``kind``) that the patterns of the ``known`` ones agree on, without those."""
    # Contexts are patterns for a kind once enough known instances of it have been seen there; all
    # instances of the context, of any kind, count against it.
    totals = edges.groupBy("context").agg(F.countDistinct("instance").alias("total"))
    seeds = edges.join(known, ["instance", "kind"], "left_semi").groupBy("context", "kind")
    seeds = seeds.agg(F.count("*").alias("seeds")).where(F.col("seeds") >= SUPPORT)
    patterns = scratch.write(seeds.join(totals, "context"), f"patterns-{number}")
    open_edges = edges.join(known, ["instance", "kind"], "left_anti")
    open_edges = scratch.write(
        open_edges.join(patterns.select("context", "kind"), ["context", "kind"]), f"open-{number}"
    )
    score = None
    for n in range(rounds):
        if score is None:
            gained = patterns.withColumn("gained", F.lit(0.0))
        else:
            by_pattern = open_edges.join(score, ["instance", "kind"]).groupBy("context", "kind")
            gained = patterns.join(
                by_pattern.agg(F.sum("score").alias("gained")), ["context", "kind"], "left"
            )
        confidence = gained.select(
            "context",
            "kind",
            ((F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / (F.col("total") + DOUBT)).alias("c"),
        )
        votes = open_edges.join(confidence, ["context", "kind"]).groupBy("instance", "kind")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("c"), F.lit(1e-9)))))
        score = scratch.write(votes.agg((1 - doubt).alias("score")), f"score-{number}-{n}")
    fresh = score.where(F.col("score") >= CONFIDENCE).select("instance", "kind")
    fresh = scratch.write(fresh, f"fresh-{number}")
    scratch.drop(f"patterns-{number}", f"open-{number}", *(f"score-{number}-{n}" for n in range(rounds)))
    return fresh


def confident_instances(found: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """(``instance``, ``kind``) of look-alikes that the patterns agree on.

    Copies of a text add nothing: the graph has each pair of context and instance once. What a
    generation accepts is known to the next one and makes patterns there, until nothing is added;
    each generation but the last adds an instance, so it ends.
    """
    mention = found.select(F.explode("mentions").alias("m"))
    edges = mention.select(
        F.explode("m.contexts").alias("context"), F.col("m.instance").alias("instance"),
        F.explode("m.could_be").alias("kind"), (F.col("m.seed") >= 0).alias("seed"),
    )
    edges = edges.groupBy("context", "instance", "kind").agg(F.max("seed").alias("seed"))
    edges = scratch.write(edges, "edges")
    known = edges.where("seed").select("instance", "kind").distinct()
    known = scratch.write(known, "known-0")
    accepted, number = known.limit(0), 0
    while True:
        fresh = generation(edges, known, scratch, number, rounds)
        if fresh.isEmpty():
            return accepted
        number += 1
        accepted = scratch.write(accepted.unionByName(fresh), f"accepted-{number}")
        known = scratch.write(known.unionByName(fresh), f"known-{number}")
        scratch.drop(f"known-{number - 1}", f"fresh-{number - 1}")
        if number > 1:
            scratch.drop(f"accepted-{number - 1}")


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` (spans of the fixed patterns) and ``added`` (spans found by context).

    Spans are (``start``, ``kind`` as a number into KINDS, ``stop``) in code points, ascending. Each
    row has its own; null and empty texts have none. Added spans don't touch fixed ones.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(found_rows(docs), "found")
    accepted = confident_instances(found, scratch)
    mention = found.select("uid", F.explode("mentions").alias("m")).where("m.seed < 0")
    mention = mention.select("uid", "m.start", "m.stop", "m.instance", F.explode("m.could_be").alias("kind"))
    added = mention.join(accepted, ["instance", "kind"]).groupBy("uid").agg(
        F.array_sort(F.collect_set(F.struct("start", "kind", "stop"))).alias("added")
    )
    nothing = F.expr("cast(array() as array<struct<start:long,kind:int,stop:long>>)")
    return found.select("uid", "doc_id", "base").join(added, "uid", "left").select(
        "doc_id", "base", F.coalesce("added", nothing).alias("added")
    )


def spans_text(column):
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            column,
            lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def op9_personal_data(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    both = F.array_sort(F.concat("base", "added"))
    return found.select(
        "doc_id",
        *counts,
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(both).alias("spans"),
    )
