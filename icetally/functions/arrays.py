"""Expressions over the on-ice token list, which alternates sweater number and position."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def every_other(tokens: Column, start: int) -> Column:
    """Elements at positions start, start+2, ... (0-based)."""
    return F.filter(tokens, lambda _, i: i % 2 == start)


def positions_of(tokens: Column, value: str) -> Column:
    """0-based positions at which ``value`` occurs."""
    marked = F.transform(tokens, lambda x, i: F.when(x == value, i))
    return F.filter(marked, lambda i: i.isNotNull())


def on_ice_codes(tokens: Column) -> Column:
    """``['11','C','30','G']`` to ``['C11','G30']``; an unpaired last number is left out."""
    numbers, positions = every_other(tokens, 0), every_other(tokens, 1)
    return F.transform(positions, lambda p, i: F.concat(p, F.get(numbers, i)))


def players_on_ice(tokens: Column) -> Column:
    return F.floor(F.size(tokens) / 2).cast("int")


def split_on_ice(tokens: Column, even_cut: str = "empty") -> tuple[Column, Column]:
    """Split the tokens into the away and the home list.

    The first ``'G'`` closes the away side. With fewer than ten players both lists are empty. When
    the only goalie listed is the last token, the list is cut by head count instead, which is exact
    for an odd number of players; for an even number the cut would halve a pair, so both lists come
    out empty (``even_cut='keep'`` cuts anyway).
    """
    n = players_on_ice(tokens)
    goalie = F.array_position(tokens, "G").cast("int")
    size = F.size(tokens)
    by_goalie = goalie < size
    unusable = n < 10
    if even_cut == "empty":
        unusable = unusable | (~by_goalie & (n % 2 == 0))
    away = (
        F.when(unusable, empty_strings())
        .when(by_goalie, F.slice(tokens, 1, F.greatest(goalie, F.lit(0))))
        .otherwise(F.slice(tokens, 1, n + 1))
    )
    home = (
        F.when(unusable, empty_strings())
        .when(by_goalie, F.slice(tokens, goalie + 1, size))
        .otherwise(F.slice(tokens, n + 2, size))
    )
    return away, home


def sweaters(codes: Column) -> Column:
    """Sweater numbers of a list of on-ice codes."""
    return F.transform(codes, lambda code: F.regexp_replace(code, "[^0-9]", ""))
