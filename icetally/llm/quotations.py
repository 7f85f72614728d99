"""Conversations in reply order, with quotations linked to what they quote.

Quote marks give each line a level. Runs of one level are quoted passages; they are hashed, in
normal form, as wholes, paragraphs, lines and sentences, and meet the messages' own passages in one pass over
each hash, where the latest earlier message with it is its source. A message answers the source of
its outermost quotation and is placed right behind it. Quotations and the lines that introduce
them are left out of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from icetally.llm.lines import ranked
from icetally.llm.shared import Scratch, batched, rows

MARKS = re.compile(r"(?:[ \t]*>)+")
INTRODUCTION = re.compile(r".*\b(?:wrote|writes|said|schrieb|écrit|escribió)\s*:\s*")
SENTENCE_END = re.compile(r"""(?:(?<=[.!?])|(?<=[.!?]["')\]]))\s+|(?<=[。！？])""")
WHOLE, PARAGRAPH, LINE, SENTENCE = 3, 2, 1, 0

PARSED_ARROW = pa.schema(
    [("uid", pa.int64()), ("clean", pa.string()), ("n_quoted", pa.int64()),
     ("passages", pa.list_(pa.struct([
         ("level", pa.int32()), ("grain", pa.int32()), ("words", pa.int32()),
         ("h1", pa.int64()), ("h2", pa.int64())])))]
)
PARSED = (
    "uid long, clean string, n_quoted long,"
    " passages array<struct<level:int,grain:int,words:int,h1:long,h2:long>>"
)


def levels(text: str) -> list[tuple[int, str]]:
    """The quote level and the rest of each line."""
    out = []
    for line in text.split("\n"):
        marks = MARKS.match(line)
        out.append((marks.group().count(">"), line[marks.end() :]) if marks else (0, line))
    return out


def runs(lines: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """Neighbouring lines of one level."""
    out: list[tuple[int, list[str]]] = []
    for level, line in lines:
        if not out or out[-1][0] != level:
            out.append((level, []))
        out[-1][1].append(line)
    return out


def pieces(level: int, lines: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """A passage as a whole, by paragraphs, by lines and by the sentences of its paragraphs, each
    piece once: case and spaces don't count, so that other line breaks and indents give the same
    hash."""
    paragraphs: list[list[str]] = [[]]
    for line in lines:
        if line.strip():
            paragraphs[-1].append(line)
        elif paragraphs[-1]:
            paragraphs.append([])
    joined = [" ".join(p) for p in paragraphs]
    seen = set()
    for grain, parts in (
        (WHOLE, [" ".join(lines)]),
        (PARAGRAPH, joined),
        (LINE, lines),
        (SENTENCE, [s for p in joined for s in SENTENCE_END.split(p)]),
    ):
        for part in parts:
            words = part.lower().split()
            normal = " ".join(words).encode()
            if words and normal not in seen:
                seen.add(normal)
                one, two = (xxhash.xxh64_intdigest(normal, s) - (1 << 63) for s in (1, 2))
                yield level, grain, len(words), one, two


def parse(text: str) -> tuple[str, int, list[tuple]]:
    """Own text, number of quoted lines, pieces of all passages."""
    lines = levels(text)
    own: list[str] = []
    for i, (level, line) in enumerate(lines):
        if level:
            continue
        follows = next((n for n, rest in lines[i + 1 :] if n or rest.strip()), 0) if INTRODUCTION.fullmatch(line) else 0
        if not follows:
            own.append(line)
    n_quoted = sum(1 for level, _ in lines if level)
    found = [p for level, part in runs(lines) if level for p in pieces(level, part)]
    found += pieces(0, own)
    clean = "\n".join(own) if not n_quoted else re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n")
    return clean, n_quoted, found


def parsed(messages: DataFrame) -> DataFrame:
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("level", "grain", "words", "h1", "h2")

        def records() -> Iterator[tuple]:
            for uid, text in rows(batches, "uid", "text"):
                clean, n_quoted, found = parse(text or "")
                yield uid, None if text is None else clean, n_quoted, [dict(zip(names, p)) for p in found]

        yield from batched(records(), PARSED_ARROW, 500)

    return messages.select("uid", "text").mapInArrow(take, PARSED)


def quotations(messages: DataFrame, read: DataFrame, scratch: Scratch) -> DataFrame:
    """The source of each quoting message and level: ``uid``, ``level``, ``source``, ``source_turn``.

    The best piece counts: wholes before paragraphs before lines before sentences, then the
    longest, then the latest.
    """
    place = messages.select("uid", "conv_id", "turn")
    piece = read.select("uid", F.explode("passages").alias("p")).select("uid", "p.*")
    quoted = scratch.write(piece.where("level > 0").join(place, "uid"), "quoted")
    own = piece.where("level = 0").join(
        quoted.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi"
    )
    both = own.join(place, "uid").unionByName(quoted)
    # One pass over a hash finds each quotation's latest earlier source, however many have it.
    own_place = F.when(F.col("level") == 0, F.struct("turn", "uid"))
    earlier = (
        Window.partitionBy("conv_id", "h1", "h2").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    )
    met = both.withColumn("source", F.max(own_place).over(earlier))
    met = met.where("level > 0 and source is not null")
    best = F.max(F.struct("grain", "words", F.col("source.turn").alias("turn"), F.col("source.uid").alias("uid")))
    found = met.groupBy("uid", "level").agg(best.alias("best"))
    return found.select("uid", "level", F.col("best.uid").alias("source"), F.col("best.turn").alias("source_turn"))


def reply_paths(messages: DataFrame, parents: DataFrame, scratch: Scratch) -> DataFrame:
    """``uid`` and ``path``: the (turn, uid) of all that a message answers, and its own.

    Paths grow by joining them end to end, so the rounds follow the logarithm of the depth.
    """
    own = F.array(F.struct("turn", "uid"))
    state = messages.join(parents, "uid", "left").select("uid", F.col("parent").alias("above"), own.alias("path"))
    done, left, n = None, scratch.write(state, "paths-0"), 0
    while True:
        top = left.where("above is null").drop("above")
        done = top if done is None else done.union(top)
        open_ = left.where("above is not null")
        if open_.isEmpty():
            return done
        n += 1
        every = left.select(F.col("uid").alias("above"), F.col("above").alias("next"), F.col("path").alias("front"))
        ended = done.select(F.col("uid").alias("above"), F.lit(None).cast("long").alias("next"), F.col("path").alias("front"))
        step = every.where("next is not null").union(ended)
        joined = open_.join(step, "above").select("uid", F.col("next").alias("above"), F.concat("front", "path").alias("path"))
        left = scratch.write(joined, f"paths-{n}")


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: ``conv_id``, ``turn``, ``role``, ``place``, ``depth``, ``reply_to``,
    ``quotes``, ``n_quoted``, ``text``.

    ``place`` counts from 0 in each conversation: messages that quote nothing of it in the order of
    turns, and behind each of them, depth first, those that answer it. ``reply_to`` is the turn of
    the message answered (null: none), ``depth`` the number of messages above, ``quotes`` the source
    turn of each level. The text has no quotations; a null text stays null. Rows without ``conv_id``
    are one conversation; rows without turn come first and answer nothing; equal turns are
    ordered anyhow. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(messages.sparkSession)
    given = messages.select(
        F.monotonically_increasing_id().alias("uid"), "conv_id", "turn", "role", "text"
    )
    given = scratch.write(given, "messages")
    read = scratch.write(parsed(given), "parsed")
    found = scratch.write(quotations(given, read, scratch), "quotations")
    # The outermost quotation with a source says what is answered.
    by_message = found.groupBy("uid").agg(
        F.min(F.struct("level", "source", "source_turn")).alias("outer"),
        F.array_sort(F.collect_list(F.struct("level", "source_turn"))).alias("quotes"),
    )
    by_message = scratch.write(by_message, "by-message")
    parents = by_message.select("uid", F.col("outer.source").alias("parent"))
    paths = scratch.write(reply_paths(given, parents, scratch), "paths")
    keyed = given.select("uid", "conv_id").join(paths, "uid").withColumn("size", F.lit(1).cast("long"))
    # Places come from ranks over ranges of the order: a long conversation is no single task.
    order = scratch.write(ranked(keyed, ["conv_id", "path"], scratch, "order"), "order")
    first = order.groupBy("conv_id").agg(F.min("rank").alias("base"))
    first = first.withColumnRenamed("conv_id", "of")
    placed = order.join(first, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "uid",
        (F.col("rank") - F.col("base")).alias("place"),
        (F.size("path") - 1).alias("depth"),
    )
    nothing = F.expr("cast(array() as array<struct<level:int,source_turn:bigint>>)")
    return (
        given.drop("text")
        .join(placed, "uid")
        .join(read.select("uid", "clean", "n_quoted"), "uid")
        .join(by_message, "uid", "left")
        .select(
            "conv_id", "turn", "role", "place", "depth",
            F.col("outer.source_turn").alias("reply_to"),
            F.coalesce("quotes", nothing).alias("quotes"),
            "n_quoted",
            F.col("clean").alias("text"),
        )
    )


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
