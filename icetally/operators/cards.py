"""Card pages to attribute rows.

The four page kinds differ in two respects: whether the header is marked by id or by class, and how
the statistics are written (a table row per statistic for goalies, an element id for skaters).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import bound

# Patterns of the card pages.
HEADER = {
    "id": r'(?s)<div id="player_header">(.*?)</div>',
    "class": r'(?s)<div class="player_header">(.*?)</div>',
}
BIO_TABLE = r'(?s)<table[^>]*id="player_bio_table"[^>]*>.*?</table>'
BIO_TITLE = r'<td class="bio_title">(.*?)</td>'
BIO_RESULT = r'<td class="bio_result">(.*?)</td>'
GOALIE_AREA = r'(?s)<div[^>]*id="player_bio_stats"[^>]*>.*?</div>'
GOALIE_STAT = r'<tr><td>(.*?)</td><td class="stat">(.*?)</td></tr>'
SKATER_AREA = r'(?s)<tr[^>]*class="stat_row"[^>]*>.*?</tr>'
SKATER_STAT = r'id="(.*?)">(.*?)<'


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _area(pattern: str) -> Column:
    return F.array_join(_all(F.col("html"), pattern, 0), "\n")


def _named(names: Column, values: Column) -> Column:
    """Names with the values at their places."""
    return bound(
        values, lambda found: F.transform(names, lambda n, i: F.struct(n.alias("name"), F.get(found, i).alias("value")))
    )


def _bio(html_area: Column) -> Column:
    def listed(area: Column) -> Column:
        titles = F.transform(_all(area, BIO_TITLE, 1), F.lower)
        return _named(titles, F.transform(_all(area, BIO_RESULT, 1), F.lower))

    return bound(html_area, listed)


def _stats(position: str) -> Column:
    pattern = GOALIE_STAT if position == "goalie" else SKATER_STAT
    area = _area(GOALIE_AREA if position == "goalie" else SKATER_AREA)
    return bound(area, lambda text: _named(_all(text, pattern, 1), _all(text, pattern, 2)))


def _last_of_each(entries: Column) -> Column:
    """The last entry of each name. Its first position in the reversed list; all lists are made once."""

    def picked(backwards: Column, names: Column) -> Column:
        return F.transform(
            F.array_distinct(names),
            lambda name: F.get(backwards, (F.array_position(names, name) - 1).cast("int")),
        )

    def named(backwards: Column) -> Column:
        return bound(F.transform(backwards, lambda e: e["name"]), lambda names: picked(backwards, names))

    return bound(F.reverse(entries), named)


def card_rows(pages: DataFrame, position: str, header_by: str) -> DataFrame:
    """Cards (``id, html``) with the name parts and all attributes found, as a map.

    ``position`` is ``skater`` or ``goalie``; ``header_by`` is ``id`` or ``class`` (the latter since
    the 2023 edition). A later attribute of the same name replaces an earlier one.
    """
    full = F.nullif(F.regexp_extract("html", HEADER[header_by], 1), F.lit(""))
    entries = F.concat(_bio(_area(BIO_TABLE)), _stats(position))
    return pages.select(
        F.col("id").alias("player_id"),
        full.alias("player_full_name"),
        F.split_part(full, F.lit(" "), F.lit(1)).alias("player_first_name"),
        F.regexp_replace(full, "^[^ ]* ?", "").alias("player_last_name"),
        F.map_from_entries(_last_of_each(entries)).alias("attributes"),
    )


def edition_year(gameyear: str) -> int:
    """Two-digit year at the end of an edition name."""
    return int(gameyear[-2:])


def card_table(pages: DataFrame, gameyear: str, position: str) -> tuple[DataFrame, DataFrame]:
    """Readable cards of one edition, and the ids of pages that are not cards."""
    cards = edition_cards(pages, gameyear, position)
    readable = F.col("player_full_name").isNotNull()
    return cards.where(readable), cards.where(~readable).select("player_id", "gameyear")


def edition_cards(pages: DataFrame, gameyear: str, position: str) -> DataFrame:
    """All pages of one edition, read once; those that are not cards have neither name nor
    attributes."""
    header_by = "class" if edition_year(gameyear) >= 23 else "id"
    cards = card_rows(pages, position, header_by).withColumn("gameyear", F.lit(gameyear))
    card = F.col("player_full_name").isNotNull()
    only = ["player_first_name", "player_last_name", "attributes"]
    return cards.withColumns({c: F.when(card, F.col(c)) for c in only})
