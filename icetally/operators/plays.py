"""Event text to typed columns: one parser per event code, and the single-pass sparse table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import sweaters
from ..functions.text import digits, flag, holds, squeeze
from ..schemas import PARSED_TYPES, SPARSE_EVENT_COLUMNS

Columns = dict[str, Column]

# Patterns of the report texts.
SEASON_COUNT = r"\((\d+)\)"
PENALTY_MINUTES = r"\((\d+\s*min)\)"
PENALTY_MARKS = r"\(maj\)|\(\d+\s*min\)"
OFFENDER = r"([A-Z]{3})\s*#(\d{1,2})\s*([A-Za-z]+)"


# Where the text of each code is cut, and where its first and second piece are cut.
CUTS = {
    "FAC": ("-", " won ", " vs "),
    "HIT": (",", " HIT ", None),
    "BLOCK": (" BLOCKED BY ", None, ","),
    "MISS": (", ", None, None),
    "GIVE": (",", None, None),
    "PENL": ("Drawn By:", ",", None),
    "GOAL": ("Assists:", ",", "; "),
    "TAKE": (",", None, None),
    "SHOT": ("ONGOAL -", None, ","),
}
# Phrases that are dropped from a text before it is cut.
PHRASES = {"GIVE": "GIVEAWAY - ", "TAKE": "TAKEAWAY - "}


@dataclass(frozen=True)
class Pieces:
    """The pieces of an event text, and those of its first and second piece."""

    cut: Column
    head: Column
    tail: Column

    def of(self, pieces: Column, i: int) -> Column:
        return F.trim(F.get(pieces, F.lit(i)))


def _cleaned(code: str, detail: Column) -> Column:
    if code not in PHRASES:
        return detail
    return squeeze(F.replace(detail, F.lit(PHRASES[code]), F.lit(" ")))


def _counter(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, SEASON_COUNT, 1), F.lit("")).try_cast("int")


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SEASON_COUNT, ""))


def sweater_place(codes: Column, text: Column) -> Column:
    """1-based place of the sweater number within a list of on-ice codes, 0 if absent."""
    return F.array_position(sweaters(codes), text).cast("int")


def faceoff(p: Pieces) -> Columns:
    return {
        "fo_winning_team": p.of(p.head, 0),
        "fo_zone": p.of(p.head, 1),
        "fo_away_player": p.of(p.tail, 0),
        "fo_home_player": p.of(p.tail, 1),
    }


def hit(p: Pieces) -> Columns:
    return {
        "hit_location": p.of(p.cut, 1),
        "hitter": p.of(p.head, 0),
        "hittee": p.of(p.head, 1),
    }


def block(p: Pieces) -> Columns:
    return {
        "shooter": p.of(p.cut, 0),
        "blocker": p.of(p.tail, 0),
        "shot_type": p.of(p.tail, 1),
        "block_location": p.of(p.tail, 2),
    }


def miss(p: Pieces) -> Columns:
    names = ["shooter", "shot_type", "shot_result", "shot_zone", "shot_distance"]
    return {name: p.of(p.cut, i) for i, name in enumerate(names)}


def giveaway(p: Pieces) -> Columns:
    return {"giveaway_player": p.of(p.cut, 0), "giveaway_zone": p.of(p.cut, 1)}


def takeaway(p: Pieces) -> Columns:
    return {"takeaway_player": p.of(p.cut, 0), "takeaway_zone": p.of(p.cut, 1)}


def penalty(p: Pieces) -> Columns:
    text = p.of(p.head, 0)
    unmarked = F.trim(F.regexp_replace(text, PENALTY_MARKS, ""))
    return {
        "penalty_drawn_by": p.of(p.cut, 1),
        "penalty_committed_by": F.regexp_extract(unmarked, OFFENDER, 0),
        "penalty_zone": p.of(p.head, 1),
        "penalty_detail": F.trim(F.regexp_replace(unmarked, OFFENDER, "")),
        "maj_flag": flag(text.contains("(maj)")),
        "penalty_duration": F.regexp_extract(text, PENALTY_MINUTES, 1),
    }


def goal(p: Pieces) -> Columns:
    scorer = p.of(p.head, 0)
    team = F.left(scorer, F.lit(3))
    first = F.concat(team, F.lit(" "), p.of(p.tail, 0))
    second = F.concat(team, F.lit(" "), p.of(p.tail, 1))
    return {
        "goal_scorer": _plain(scorer),
        "goal_scorer_team": team,
        "goal_scorer_shottype": p.of(p.head, 1),
        "goal_scorer_shotzone": p.of(p.head, 2),
        "goal_scorer_shotdist": p.of(p.head, 3),
        "primary_assist_player": _plain(first),
        "secondary_assist_player": _plain(second),
        "goal_scorer_num_goals": _counter(scorer),
        "primary_assistor_num_assists": _counter(first),
        "secondary_assistor_num_assists": _counter(second),
    }


def shot(p: Pieces) -> Columns:
    team = F.left(F.get(p.cut, F.lit(0)), F.lit(3))
    return {
        "shooting_team": team,
        "shooter": F.concat(team, F.lit(" "), p.of(p.tail, 0)),
        "shot_type": p.of(p.tail, 1),
        "shot_zone": p.of(p.tail, 2),
        "shot_distance": p.of(p.tail, 3),
    }


PARSERS: dict[str, Callable[[Pieces], Columns]] = {
    "FAC": faceoff,
    "HIT": hit,
    "BLOCK": block,
    "MISS": miss,
    "GIVE": giveaway,
    "PENL": penalty,
    "GOAL": goal,
    "TAKE": takeaway,
    "SHOT": shot,
}

# Roles that carry a "TEAM #NN NAME" text, per event code.
ROLES: dict[str, list[str]] = {
    "FAC": [],
    "HIT": ["hitter", "hittee"],
    "BLOCK": ["shooter", "blocker"],
    "MISS": ["shooter"],
    "GIVE": ["giveaway_player"],
    "PENL": ["penalty_committed_by", "penalty_drawn_by"],
    "GOAL": ["goal_scorer", "primary_assist_player", "secondary_assist_player"],
    "TAKE": ["takeaway_player"],
    "SHOT": ["shooter"],
}
SLOTS = max(len(roles) for roles in ROLES.values())

# Sparse column <- parsed column, per code, where the names differ; a leading "=" is a constant.
_FACEOFF = {
    "zone": "fo_zone",
    "faceoff_win_team": "fo_winning_team",
    "faceoff_taken_by_away": "fo_away_player",
    "faceoff_taken_by_home": "fo_home_player",
    "faceoff_taken_by_away_index": "away_onice_index",
    "faceoff_taken_by_home_index": "home_onice_index",
    "faceoff_winner_home": "winner_home",
}
_GOAL = {
    "zone": "goal_scorer_shotzone",
    "shot_type": "goal_scorer_shottype",
    "shot_distance": "goal_scorer_shotdist",
    "shooter": "goal_scorer",
    "shooter_team": "goal_scorer_team",
    "home_shooter": "home_goal_scorer",
    "shooter_onice_index": "goal_scorer_onice_index",
    "shot_result": "=Goal",
}
RENAMED: dict[str, dict[str, str]] = {
    "FAC": _FACEOFF,
    "HIT": {"zone": "hit_location"},
    "BLOCK": {"shot_result": "=Blocked"},
    "MISS": {"zone": "shot_zone"},
    "GIVE": {"zone": "giveaway_zone"},
    "PENL": {"zone": "penalty_zone"},
    "GOAL": _GOAL,
    "TAKE": {"zone": "takeaway_zone"},
    "SHOT": {"zone": "shot_zone", "shot_result": "=On-Goal"},
}


def lineup(role: Column, home_team: Column, home_codes: Column, away_codes: Column) -> Columns:
    """Team, sweater, last name, home flag and place in the own side's on-ice list of a role text."""
    words = F.split(role, " ")
    team = F.left(F.trim(F.get(words, F.lit(0))), F.lit(3))
    number = F.trim(F.replace(F.get(words, F.lit(1)), F.lit("#"), F.lit("")))
    at_home = holds(F.trim(team) == F.trim(home_team))
    own_side = F.when(at_home, home_codes).otherwise(away_codes)
    return {
        "team": team,
        "jn": number,
        "lastname": F.trim(F.get(words, F.lit(2))),
        "home": at_home,
        "onice_index": sweater_place(own_side, number),
    }


def _lineup_here(role: Column) -> Columns:
    return lineup(role, F.col("home_team"), F.col("home_onice_code"), F.col("away_onice_code"))


def append_lineup_info(df: DataFrame, role: str) -> DataFrame:
    """Add the line-up columns of one role to a table of plays with their on-ice lists."""
    info = _lineup_here(F.col(role))
    return df.withColumns(
        {
            f"{role}_team": info["team"],
            f"{role}_jn": info["jn"],
            f"{role}_lastname": info["lastname"],
            f"home_{role}": info["home"],
            f"{role}_onice_index": info["onice_index"],
        }
    )


def _takers(winner: Column, away: Column, home: Column) -> Columns:
    """Places of the two face-off takers, and whether the home team won."""
    return {
        "away_onice_index": sweater_place(F.col("away_onice_code"), digits(away)),
        "home_onice_index": sweater_place(F.col("home_onice_code"), digits(home)),
        "winner_home": holds(winner == F.col("home_team")),
    }


def _choose(choices: dict[str, Column]) -> Column:
    """The column of the row's own event code."""
    chosen = F
    for code, column in choices.items():
        chosen = chosen.when(F.col("type") == code, column)
    return chosen


def _cut_rows(df: DataFrame, codes: list[str]) -> tuple[DataFrame, Pieces]:
    """Cut the text of each row by its code: ``_cut``, and ``_head`` and ``_tail`` from it."""
    nothing = F.lit(None).cast("array<string>")

    def pieces(source: dict[str, Column], level: int) -> Column:
        cuts = {c: F.split(source[c], CUTS[c][level]) for c in codes if CUTS[c][level]}
        return _choose(cuts) if cuts else nothing

    first = {c: F.get("_cut", F.lit(0)) for c in codes}
    second = {c: F.get("_cut", F.lit(1)) for c in codes}
    rows = df.withColumn("_cut", pieces({c: _cleaned(c, F.col("detail")) for c in codes}, 0))
    rows = rows.withColumns({"_head": pieces(first, 1), "_tail": pieces(second, 2)})
    return rows, Pieces(F.col("_cut"), F.col("_head"), F.col("_tail"))


def parse_type(df: DataFrame, code: str) -> DataFrame:
    """Plays of one event code with the columns of its parser and of its roles."""
    rows, pieces = _cut_rows(df.where(F.col("type") == code), [code])
    parsed = rows.withColumns(PARSERS[code](pieces)).drop("_cut", "_head", "_tail")
    if code == "FAC":
        takers = [F.col(c) for c in ("fo_winning_team", "fo_away_player", "fo_home_player")]
        parsed = parsed.withColumns(_takers(*takers))
    for role in ROLES[code]:
        parsed = append_lineup_info(parsed, role)
    return parsed


def _targets(code: str, parsed: Columns) -> Columns:
    """Columns of the sparse table that an event code fills, from its parsed columns."""
    renamed = RENAMED[code]
    out = {}
    for target in SPARSE_EVENT_COLUMNS.names:
        source = renamed.get(target, target)
        if source.startswith("="):
            out[target] = F.lit(source[1:])
        elif source in parsed:
            out[target] = parsed[source]
    return out


def sparse_union(plays: DataFrame) -> DataFrame:
    """All plays with the event columns of every code, null where a code does not fill them.

    One scan and no shuffle. Each text is cut once, by the row's own code; the roles of a code go
    through shared slots, so a row works out at most as many line-up places as it has roles; each
    target column is then a choice by code. Codes without a parser, and rows without a code, keep
    all event columns null.
    """
    rows, pieces = _cut_rows(plays, PARSED_TYPES)
    found = {code: PARSERS[code](pieces) for code in PARSED_TYPES}
    slots = range(SLOTS)
    texts = {
        f"_role{i}": _choose(
            {c: found[c][ROLES[c][i]] for c in PARSED_TYPES if i < len(ROLES[c])}
        )
        for i in slots
    }
    rows = rows.withColumns(texts)
    kept = ("team", "home", "onice_index")
    infos = {}
    for i in slots:
        info = _lineup_here(F.col(f"_role{i}"))
        infos[f"_info{i}"] = F.struct(*[info[k].alias(k) for k in kept])
    rows = rows.withColumns(infos)
    filled = {}
    for code in PARSED_TYPES:
        parsed = dict(found[code])
        for i, role in enumerate(ROLES[code]):
            parsed[role] = F.col(f"_role{i}")
            parsed[f"{role}_team"] = F.col(f"_info{i}.team")
            parsed[f"home_{role}"] = F.col(f"_info{i}.home")
            parsed[f"{role}_onice_index"] = F.col(f"_info{i}.onice_index")
        if code == "FAC":
            takers = (parsed[c] for c in ("fo_winning_team", "fo_away_player", "fo_home_player"))
            parsed |= _takers(*takers)
        filled[code] = _targets(code, parsed)
    columns = {
        field.name: _choose({c: f[field.name] for c, f in filled.items() if field.name in f}).cast(
            field.dataType
        )
        for field in SPARSE_EVENT_COLUMNS
    }
    return rows.select(*plays.columns, *[c.alias(name) for name, c in columns.items()])


def sparse_union_by_branch(plays: DataFrame) -> DataFrame:
    """The same table as a union of one parsed frame per code; kept to check and time the above."""
    names = {f.name: f.dataType for f in SPARSE_EVENT_COLUMNS}
    parts = []
    for code in PARSED_TYPES:
        parsed = parse_type(plays, code)
        filled = _targets(code, {c: F.col(c) for c in parsed.columns})
        columns = [filled.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()]
        parts.append(parsed.select(*plays.columns, *columns))
    other = ~F.col("type").isin(PARSED_TYPES) | F.col("type").isNull()
    parts.append(plays.where(other))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
