"""Report pages to play rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import players_on_ice, split_on_ice
from ..functions.text import elapsed_seconds, html_links, html_text

# Shape of an event header, with Unicode classes so that a no-break space counts as
# blank: index, period, strength, then elapsed time and clock written without a gap.
HEADER = r"(?U)(\d+\s+\d+\s+[\w\s]*\s+\d+:\d+\d:\d+\d)"
HEADER_PARTS = r"(?Us)^(\d+)\s+(\d+)\s+(.*?)\s*?(\d+:\d{2})(\d+:\d+)$"
NO_BREAK_SPACE = "\u00a0"
START, END = "\u0001", "\u0002"


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their visible text in place of the markup."""
    return pages.withColumn("text", html_text(F.col(html))).drop(html)


def page_links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """One row per anchor target, with its place on the page."""
    return pages.select(key, F.posexplode(html_links(F.col(html))).alias("place", "href"))


def tokenize_plays(documents: DataFrame) -> DataFrame:
    """One row per event of each play text (columns ``game_id, away_team, home_team, text``).

    A mark is put before and after every event header, and the text is cut at the marks, so headers
    that repeat within a document cannot be confused. Within an event the first line is the type,
    the second the detail, and the rest, up to the last line or a copyright notice, the on-ice
    tokens. The row explodes from its own document; nothing is shuffled.
    """
    marked = F.regexp_replace("text", HEADER, f"{START}$1{END}")
    events = F.slice(F.split(marked, START), 2, 2_000_000_000)
    rows = documents.select("game_id", "away_team", "home_team", F.explode(events).alias("event"))
    header = F.split_part("event", F.lit(END), F.lit(1))
    body = F.regexp_replace(F.split_part("event", F.lit(END), F.lit(2)), "\n+", "\n")
    lines = F.filter(F.split(body, "\n"), lambda line: line != NO_BREAK_SPACE)
    rows = rows.select(
        "game_id",
        "away_team",
        "home_team",
        *[
            F.regexp_extract(header, HEADER_PARTS, i).alias(name)
            for i, name in enumerate(["index", "period", "status", "time_elapsed", "time"], 1)
        ],
        lines.alias("lines"),
    )
    tokens = F.slice("lines", 4, F.greatest(F.size("lines") - 4, F.lit(0)))
    notice = F.filter(
        F.transform(
            tokens, lambda line, i: F.when(F.lower(line).contains("copyright"), i)
        ),
        lambda i: i.isNotNull(),
    )
    kept = F.when(F.size(notice) > 0, F.slice(tokens, 1, F.get(notice, F.lit(0)))).otherwise(tokens)
    return rows.select(
        "game_id",
        "away_team",
        "home_team",
        "index",
        "period",
        "status",
        F.get("lines", F.lit(1)).alias("type"),
        F.get("lines", F.lit(2)).alias("detail"),
        "time",
        "time_elapsed",
        kept.alias("on_ice"),
    )


def raw_plays(tokenized: DataFrame) -> DataFrame:
    """Tokenised plays with elapsed seconds and the on-ice tokens of either side."""
    away, home = split_on_ice(F.col("on_ice"))
    return tokenized.withColumns(
        {
            "time_elapsed_s": elapsed_seconds(F.col("period"), F.col("time_elapsed")),
            "num_on_ice": players_on_ice(F.col("on_ice")),
            "away_onice_array1": away,
            "home_onice_array1": home,
        }
    )
