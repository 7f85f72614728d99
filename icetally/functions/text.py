"""Text and clock expressions that stay inside Spark's code generation and are safe in ANSI mode."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

MISSING = "None"  # how an absent value is spelled in the all-string landing tables
STAT_TYPE = "decimal(38,9)"  # fixed value: 29 digits before the point, 9 behind it


def field(text: Column, separator: str, position: int) -> Column:
    """Trimmed piece of ``text`` cut at the regex ``separator``; null past the end."""
    return F.trim(F.get(F.split(text, separator), F.lit(position)))


def squeeze(text: Column) -> Column:
    """Collapse runs of blanks to one blank and trim."""
    return F.trim(F.regexp_replace(text, " +", " "))


def clock_seconds(clock: Column) -> Column:
    """``'m:ss'`` to seconds; null when either part is missing or not a number."""
    minutes = field(clock, ":", 0).try_cast("bigint")
    seconds = field(clock, ":", 1).try_cast("bigint")
    return minutes * F.lit(60) + seconds


def elapsed_seconds(period: Column, clock: Column) -> Column:
    """Seconds since the opening face-off, for twenty-minute periods."""
    return ((period.try_cast("bigint") - 1) * 1200 + clock_seconds(clock)).try_cast("int")


def known(text: Column) -> Column:
    """Null for the spelled-out missing marker."""
    return F.nullif(text, F.lit(MISSING))


def stat(text: Column) -> Column:
    """Landing text to a number: missing becomes 0, unreadable text becomes null."""
    return F.coalesce(known(text), F.lit("0.0")).try_cast(STAT_TYPE)


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it does not or is unknown."""
    return F.when(condition, 1).otherwise(0)


def holds(condition: Column) -> Column:
    """Boolean in which an unknown comparison counts as false."""
    return F.coalesce(condition, F.lit(False))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


# Character references: names by first letter (most need their semicolon), the old ones that do
# without, and what the numbers from 128 to 159 stand for. All from the standard library's tables.
NAMED: dict[str, dict[str, str]] = {}
for _name, _char in html5.items():
    if _name.endswith(";"):
        NAMED.setdefault(_name[0], {})[_name] = _char
BARE = {name: char for name, char in html5.items() if not name.endswith(";")}
WINDOWS = [bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160)]
REPLACEMENT = "\ufffd"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _table(entries: dict) -> Column:
    kind = "map<string,map<string,string>>" if isinstance(next(iter(entries.values())), dict) else "map<string,string>"
    return F.from_json(F.lit(json.dumps(entries)), kind)


def _numbered(number: Column) -> Column:
    """The character of a numeric reference, as browsers read it."""
    shown = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    windows = F.get(F.array(*[F.lit(c) for c in WINDOWS]), (number - 128).cast("int"))
    no_character = number.between(0xFDD0, 0xFDEF) | (F.pmod(number, F.lit(0x10000)) >= 0xFFFE)
    control = (number < 32) & ~number.isin(9, 10, 12, 13) | (number == 127)
    return (
        F.when(number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), REPLACEMENT)
        .when(number.between(128, 159), windows)
        .when(control | no_character, "")
        .otherwise(shown)
    )


def _decoded(piece: Column) -> Column:
    """What follows an ampersand, with the reference that it begins with, if any, replaced."""

    def numeric(reference: Column) -> Column:
        digits_ = F.regexp_replace(reference, "[#;]", "")
        hexadecimal = F.lower(F.left(digits_, F.lit(1))) == "x"
        read = F.when(hexadecimal, F.conv(F.substring(digits_, 2, 16), 16, 10)).otherwise(digits_)
        # Numbers of any length: what is no long is no character either.
        char = bound(read.try_cast("bigint"), _numbered)
        return F.concat(char, F.substring(piece, F.length(reference) + 1, F.length(piece)))

    def named(reference: Column) -> Column:
        known = F.try_element_at(F.try_element_at(_table(NAMED), F.left(reference, F.lit(1))), reference)
        return F.concat(known, F.substring(piece, F.length(reference) + 1, F.length(piece)))

    def bare() -> Column:
        """The longest old name that the piece begins with."""
        lengths = sorted({len(name) for name in BARE}, reverse=True)
        names = [F.left(piece, F.lit(n)) for n in lengths]
        return F.coalesce(
            *[
                F.concat(F.try_element_at(_table(BARE), name), F.substring(piece, F.lit(n + 1), F.length(piece)))
                for n, name in zip(lengths, names)
            ]
        )

    number = F.regexp_extract(piece, "^#([0-9]+|[xX][0-9a-fA-F]+);?", 0)
    name = F.regexp_extract(piece, "^[A-Za-z][A-Za-z0-9]*;", 0)
    kept = F.concat(F.lit("&"), piece)
    return F.when(
        piece.startswith("#"), bound(number, lambda n: F.when(n == "", kept).otherwise(numeric(n)))
    ).otherwise(F.coalesce(bound(name, lambda n: F.when(n != "", named(n))), bare(), kept))


def unescaped(text: Column) -> Column:
    """Text with every character reference decoded once: what a reference stands for is text."""

    def decode(whole: Column) -> Column:
        pieces = F.split(whole, "&")
        later = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
        replaced = F.array_join(F.transform(later, _decoded), "")
        return F.when(whole.contains("&"), F.concat(F.get(pieces, F.lit(0)), replaced)).otherwise(whole)

    return bound(text, decode)


# One pass over comments, raw elements with what they hold, and tags, from left to right.
MARKUP = r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>|<[!/?a-zA-Z][^>]*>"
# Comments and raw elements alone.
HIDDEN = r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>"
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
TARGET = r"""(?is)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))$"""


def html_text(html: Column) -> Column:
    """Visible text of a page: comments, scripts, styles and tags removed, references decoded."""
    return unescaped(F.regexp_replace(html, MARKUP, ""))


def html_links(html: Column) -> Column:
    """Targets of all anchors outside comments and scripts, in page order, quoted or not."""
    anchors = F.regexp_extract_all(F.regexp_replace(html, HIDDEN, ""), F.lit(ANCHOR), F.lit(0))
    return F.transform(
        anchors, lambda tag: unescaped(F.concat(*[F.regexp_extract(tag, TARGET, n) for n in (1, 2, 3)]))
    )
