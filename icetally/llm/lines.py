"""Repeated runs of lines, by a suffix array over line ids. DataFrame operations only.

Prefix doubling: lines that occur once can't be in a repeated run, so the suffixes are those that
start with a repeated line. Their ranks by the first line are refined to ranks by the first 2, 4,
8, ... lines: the new rank of a suffix is that of the pair of its rank and the rank of the suffix
half a prefix on. A rank is the number of suffixes that sort before, counted over ranges of the sort
order, so neither a frequent line nor a frequent run is one task. Suffixes that are alone with their
prefix leave, and the doubling ends when all have.

The suffixes that share a rank are an interval of the suffix array whose longest common prefixes have
at least that many lines. The intervals of ``min_lines`` lines tell which runs are copies: each
member but the first starts one, and neighbouring members join to maximal runs. With ``min_words``
the intervals of fewer lines count too, where those lines hold that many words: a long passage on one
or two lines is a copy as well. The pipeline's line stage uses that wider rule; the query keeps to the
three lines of its SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icetally.llm.shared import Scratch, hash128

MIN_LINES = 3
MIN_WORDS = 50
"""Words that make a copy of a run of fewer lines, where the wider rule is asked for."""
NO_ID = 2**63 - 1
"""Orders rows without id behind all others."""

PLACE = ["k1", "k2", "n"]


def lines_for_words(words: Column, most: int, min_words: int) -> Column:
    """For each line the smallest number of lines from it on, up to ``most``, that hold
    ``min_words`` words; null if none does."""
    held, needed = words, F.transform(words, lambda w: F.when(w >= min_words, 1))
    for k in range(2, most + 1):
        # Past the last line there is null, and so is the sum.
        held = F.zip_with(held, F.slice(words, k, F.size(words)), lambda a, b: a + b)
        reached = F.transform(held, lambda w: F.when(w >= min_words, k))
        needed = F.zip_with(needed, reached, lambda one, other: F.coalesce(one, other))
    return needed


def line_rows(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """Lines that hold more than white space: their document (``k1``, ``k2``, ``ord``), number ``n``
    among them, position, and the 128-bit id of the line. With ``min_words`` also ``needed``, the
    number of lines under ``min_lines`` that hold so many words."""
    text = F.coalesce("text", F.lit(""))
    k1, k2 = hash128(F.col("doc_id"), text)
    lines = docs.select(
        k1.alias("k1"),
        k2.alias("k2"),
        F.coalesce("doc_id", F.lit(NO_ID)).alias("ord"),
        # Numbers are given inside the row, before the lines are dealt out.
        F.split(text, "\n").alias("lines"),
    )
    held = F.transform("lines", lambda line, at: F.struct(at.alias("pos"), line.alias("line")))
    held = F.filter(held, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    extra = []
    if min_words is not None and min_lines > 1:
        words = F.transform(held, lambda x: F.regexp_count(x["line"], F.lit(r"[^\x20\x09-\x0D]+")))
        needed = lines_for_words(words, min_lines - 1, min_words)
        held = F.zip_with(
            held, needed, lambda x, n: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), n.alias("needed"))
        )
        extra = [F.col("x.needed").alias("needed")]
    each = lines.select("k1", "k2", "ord", F.size("lines").alias("total"), F.posexplode(held).alias("n", "x"))
    h1, h2 = hash128(F.col("x.line"))
    return each.select(
        "k1", "k2", "ord", "total", "n", F.col("x.pos").alias("pos"), h1.alias("h1"), h2.alias("h2"), *extra
    )


def ranked(groups: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Adds ``rank``: the sum of ``size`` over the groups that sort before. Ranges of the order are
    summed first, then numbered within; nothing sees all groups."""
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id())
    dealt = scratch.write(dealt, f"{name}-ranges")
    # One row for each range.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("range").agg(F.sum("size").alias("held"))
    starts = starts.select("range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return inner.join(starts, "range").select(
        *groups.columns, (F.col("start") + F.col("inner")).alias("rank")
    )


def next_rank(suffixes: DataFrame, distance: int) -> DataFrame:
    """Adds ``then``: the rank of the suffix that starts so many lines on in the document, if that
    suffix is still there."""
    ahead = Window.partitionBy("k1", "k2").orderBy("n").rangeBetween(distance, distance)
    return suffixes.withColumn("then", F.first("rank").over(ahead))


def suffix_levels(
    docs: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES, min_words: int | None = None
) -> list[DataFrame]:
    """The suffixes that share their first 1, 2, 4, ... lines with others, with their ranks by
    those lines; one table for each length, until no suffix shares more."""
    lines = scratch.write(line_rows(docs, min_lines, min_words), "lines")
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("size")).where("size > 1")
    again = lines.join(often.select("h1", "h2"), ["h1", "h2"]).dropDuplicates(PLACE)
    again = scratch.write(again, "repeated")
    scratch.drop("lines")
    ids = again.groupBy("h1", "h2").agg(F.count("*").alias("size")).where("size > 1")
    ids = scratch.write(ranked(ids, ["h1", "h2"], scratch, "level-0"), "ids")
    first = again.join(ids.select("h1", "h2", "rank"), ["h1", "h2"]).drop("h1", "h2")
    levels = [scratch.write(first, "level-0")]
    while True:
        k = len(levels)
        pairs = scratch.write(next_rank(levels[-1], 1 << (k - 1)).where("then is not null"), f"pairs-{k}")
        shared = pairs.groupBy("rank", "then").agg(F.count("*").alias("size")).where("size > 1")
        shared = shared.withColumnRenamed("rank", "head")
        shared = scratch.write(ranked(shared, ["head", "then"], scratch, f"level-{k}"), f"shared-{k}")
        if shared.isEmpty():
            return levels
        members = pairs.withColumnRenamed("rank", "head").join(
            shared.select("head", "then", "rank"), ["head", "then"]
        )
        levels.append(scratch.write(members.drop("head", "then"), f"level-{k}"))
        scratch.drop(f"pairs-{k}", f"shared-{k}", f"level-{k}-ranges")


def intervals(levels: list[DataFrame], length: int) -> DataFrame:
    """Members of the intervals whose common prefixes have at least ``length`` lines, named by two
    ranks (``head``, ``then``) whose prefixes overlap to that length."""
    level = length.bit_length() - 1
    if level >= len(levels):
        return levels[-1].withColumns({"head": F.col("rank"), "then": F.col("rank")}).limit(0)
    rest = length - (1 << level)
    suffixes = levels[level]
    both = next_rank(suffixes, rest) if rest else suffixes.withColumn("then", F.col("rank"))
    return both.where("then is not null").withColumnRenamed("rank", "head")


def copy_starts(members: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """The lines (``n``) that are deleted because a run of ``length`` lines is a copy."""
    members = scratch.write(members, f"intervals-{length}")
    place = F.struct("ord", "k1", "k2", "n")
    heads = scratch.write(
        members.groupBy("head", "then").agg(F.min(place).alias("earliest")), f"heads-{length}"
    )
    copies = members.join(heads, ["head", "then"]).where(place > F.col("earliest"))
    # Each copy deletes so many lines from its start; the lines of a document are put together.
    return copies.select("k1", "k2", "total", F.explode(F.sequence("n", F.col("n") + (length - 1))).alias("n"))


def later_runs(
    docs: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES, min_words: int | None = None
) -> DataFrame:
    """Maximal runs of lines that are copies of earlier ones: ``k1``, ``k2``, ``total`` (lines of the
    document), ``first`` and ``stop`` (line numbers), ``n_run``, and ``positions`` in the text."""
    levels = suffix_levels(docs, scratch, min_lines, min_words)
    starts = copy_starts(intervals(levels, min_lines), min_lines, scratch)
    for length in range(1, min_lines if min_words is not None else 1):
        wordy = intervals(levels, length).where(F.col("needed") <= length)
        starts = starts.union(copy_starts(wordy, length, scratch))
    gone = starts.distinct()
    place_of = scratch.spark.read.parquet(scratch.path("repeated")).select(*PLACE, "pos")
    gone = gone.join(place_of, PLACE)
    order = Window.partitionBy("k1", "k2").orderBy("n")
    numbered = gone.withColumn("island", F.col("n") - F.row_number().over(order))
    return numbered.groupBy("k1", "k2", "total", "island").agg(
        F.min("n").alias("first"),
        (F.max("n") + 1).alias("stop"),
        F.count("*").alias("n_run"),
        F.collect_list("pos").alias("positions"),
    )


def without_repeats(
    docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None
) -> DataFrame:
    """Every row of ``docs`` (as the struct ``row``) with its text without later copies of line runs.

    ``kept_text`` (null for a null text), ``n_lines`` (lines with more than white space),
    ``n_removed``. A run of at least ``min_lines`` lines that also starts earlier, in a smaller
    ``doc_id`` or higher up in the same text, is deleted; blank lines are not counted and stay.
    With ``min_words`` so is a run of fewer lines that hold at least so many words together.
    A line repeated on and on leaves its first copy. Rows without id come after all others; rows
    with the same id and text are one document and come back alike, and different texts with one
    id, or without one, are ordered by a hash. Any other columns are kept as
    they are, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    runs = scratch.write(later_runs(docs, scratch, min_lines, min_words), "runs")
    gone = runs.groupBy("k1", "k2").agg(
        F.max("total").alias("total"),
        F.array_sort(F.flatten(F.collect_list("positions"))).alias("gone"),
    )
    gone = scratch.write(gone, "gone")
    # A flag for each line: those kept before each deleted one, that one, and those after the last.
    before = F.transform(
        "gone",
        lambda at, i: F.concat(
            F.array_repeat(F.lit(True), at - F.when(i > 0, F.get("gone", i - 1)).otherwise(-1) - 1),
            F.array(F.lit(False)),
        ),
    )
    after = F.array_repeat(F.lit(True), F.col("total") - 1 - F.element_at("gone", -1))
    flags = gone.select(
        "k1",
        "k2",
        F.size("gone").cast("long").alias("n_removed"),
        F.concat(F.flatten(before), after).alias("kept"),
    )
    flags = scratch.write(flags, "flags")
    text = F.coalesce("text", F.lit(""))
    k1, k2 = hash128(F.col("doc_id"), text)
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    whole = docs.select(
        F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2"), F.size(full).cast("long").alias("n_lines")
    )
    # The flags grow with the documents, so they are merged at every size and never broadcast.
    joined = whole.join(flags.hint("merge"), ["k1", "k2"], "left")
    picked = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: F.get("kept", i)), "\n")
    return joined.select(
        "row",
        F.when(F.col("kept").isNull(), F.col("row.text")).otherwise(picked).alias("kept_text"),
        "n_lines",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
    )


def without_copied_lines(
    docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS
) -> DataFrame:
    """``docs`` with shortened texts and ``n_chars``, if there, counted anew. Rows that had lines and
    have none left are copies and go; rows without lines stay as they are. Runs of fewer than
    ``min_lines`` lines count as copies from ``min_words`` words on."""
    found = without_repeats(docs, min_lines, min_words).where("n_removed < n_lines or n_lines = 0")
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        short = F.length("kept_text").cast(kind)
        changed["n_chars"] = F.when(F.col("n_removed") > 0, short).otherwise(F.col("row.n_chars"))
    return found.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_removed",
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"),
    )


LINE_SQL = """
with lines as (
  select doc_id, generate_subscripts(x, 1) - 1 as pos, unnest(x) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)),
filled as (
  select *, row_number() over (partition by doc_id order by pos) - 1 as n
  from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
windows as (
  select doc_id, n, line as l0, lead(line, 1) over d as l1, lead(line, 2) over d as l2
  from filled window d as (partition by doc_id order by n)),
copies as (
  select doc_id, n from windows where l2 is not null
  qualify row_number() over (partition by l0, l1, l2 order by doc_id, n) > 1),
gone as (select distinct doc_id, n + k as n from copies, (values (0), (1), (2)) t(k)),
flagged as (
  select l.doc_id, l.pos, l.line, f.n is not null as full_line, g.n is not null as removed
  from lines l left join filled f using (doc_id, pos) left join gone g on g.doc_id = l.doc_id and g.n = f.n)
"""

OP5_SQL = (
    LINE_SQL
    + """
select doc_id, count(*) filter (full_line) as n_lines, count(*) filter (removed) as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not removed), '')) as kept_sha256
from flagged group by doc_id
"""
)
