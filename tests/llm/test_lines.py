"""Line runs against brute force and against SQL."""

import random
import re

import pytest

from compare import connect, differences
from icetally.llm import lines

FULL = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows, min_lines):
    """Kept text, lines and removed lines of each row."""
    split = [(d, t, [(i, x) for i, x in enumerate((t or "").split("\n")) if FULL.search(x)]) for d, t in rows]
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t, own in split:
        for a in range(len(own) - min_lines + 1):
            key = tuple(x for _, x in own[a : a + min_lines])
            first.setdefault(key, []).append((order(d), a, t))
    out = []
    for d, t, own in split:
        gone = set()
        for a in range(len(own) - min_lines + 1):
            key = tuple(x for _, x in own[a : a + min_lines])
            if any((o, b) < (order(d), a) for o, b, _ in first[key] if o < order(d)) or any(
                o == order(d) and u == t and b < a for o, b, u in first[key]
            ):
                gone.update(i for i, _ in own[a : a + min_lines])
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        out.append((d, kept, len(own), len(gone)))
    return sorted(out, key=str)


def make():
    rnd = random.Random(8)
    line = lambda: f"line {rnd.randint(0, 25)}"
    rows = [(i, "\n".join(line() for _ in range(rnd.randint(0, 14)))) for i in range(60)]
    block = "\n".join(f"shared {i}" for i in range(9))
    rows += [(100 + i, f"own {i}\n{block}\n\n \nend {i}") for i in range(12)]
    rows += [(200, "same\n" * 300), (201, "a\nb\nc\n" * 40), (202, "a\n\nb\n\t\nc"), (203, "x" * 50_000)]
    rows += [(300 + i, rows[i][1]) for i in range(10)]
    rows += [(400, None), (401, ""), (402, "\n\n"), (None, block), (None, None)]
    rows += [(403, block), (403, block)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("min_lines", [1, 2, 3, 4, 7])
def test_runs(spark, min_lines):
    rows = make()
    frame = spark.createDataFrame([(d, t, 1, "k", 2) for d, t in rows], "doc_id long, text string, n int, k1 string, rank int")
    found = lines.without_repeats(frame, min_lines)
    got = [(r["row"]["doc_id"], r["kept_text"], r["n_lines"], r["n_removed"]) for r in found.collect()]
    assert sorted(got, key=str) == brute(rows, min_lines)
    assert found.select("row.*").columns == frame.columns


def wide_brute(rows, min_lines, min_words):
    """Kept texts where a run of fewer lines counts too, if it holds so many words."""
    split = {d: [(i, x) for i, x in enumerate(t.split("\n")) if FULL.search(x)] for d, t in rows}
    seen, gone = set(), {d: set() for d in split}
    for d, own in sorted(split.items()):
        for a in range(len(own)):
            for length in range(1, min_lines + 1):
                run = own[a : a + length]
                lines_ = tuple(x for _, x in run)
                words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines_)
                if len(run) < length or (length < min_lines and words < min_words):
                    continue
                if lines_ in seen:
                    gone[d].update(i for i, _ in run)
                seen.add(lines_)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


@pytest.mark.parametrize("min_lines", [1, 3, 4])
def test_long_passages_on_few_lines(spark, min_lines):
    """A passage of 50 words is a copy on one line or two, alone or within a document."""
    rnd = random.Random(21)
    line = lambda n: " ".join(f"w{rnd.randint(0, 300)}" for _ in range(n))
    one, left, right, short = line(66), line(30), line(20), line(49)
    rows = [(0, f"{line(4)}\n{one}\n{line(5)}\n{left}\n\n{right}\nend\n{short}"), (1, one)]
    rows += [(2, f"own\n{one}\nmine"), (3, f"{left}\n{right}"), (4, f"{left}\n{line(3)}\n{right}"), (5, short)]
    rows += [(6, f"{one}\n{left}\n{one}\n{left}"), (7, f"x\n{left}\n \n{right}\ny"), (8, f"{one} "), (9, "")]
    pool = [line(n) for n in (3, 10, 25, 40, 49, 50, 60, 24, 26, 1)]
    rows += [(20 + i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 6)))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["row"]["doc_id"]: r["kept_text"] for r in lines.without_repeats(frame, min_lines, 50).collect()}
    assert got == wide_brute(rows, min_lines, 50)
    if min_lines == 3:
        assert (got[2], got[3], got[5], got[7]) == ("own\nmine", "", short, "x\n \ny")
        stay = {r["doc_id"]: r["text"] for r in lines.without_copied_lines(frame).collect()}
        assert stay == {d: t for d, t in got.items() if t.strip() or d == 9}
    plan = lines.without_copied_lines(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_main_path_is_native(spark):
    frame = spark.createDataFrame(make(), "doc_id long, text string")
    plan = lines.without_repeats(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_suffix_order(spark):
    """Ranks sort the suffixes that share a prefix, and equal prefixes have equal ranks."""
    rows = [(0, "a\nb\na\nb\nc"), (1, "b\na\nb\nc\nx"), (2, "a\nb\nc")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = lines.Scratch(spark)
    levels = lines.suffix_levels(frame, scratch)
    texts = {d: t.split("\n") for d, t in rows}
    for k, level in enumerate(levels):
        by_rank, sizes = {}, {}
        for r in level.collect():
            prefix = tuple(texts[r["ord"]][r["n"] : r["n"] + (1 << k)])
            assert len(prefix) == 1 << k
            assert by_rank.setdefault(r["rank"], prefix) == prefix
            sizes[r["rank"]] = sizes.get(r["rank"], 0) + 1
        assert len(set(by_rank.values())) == len(by_rank) and min(sizes.values()) > 1
        at = 0
        for rank in sorted(sizes):
            assert rank == at
            at += sizes[rank]


def test_no_rows(spark, no_docs):
    assert lines.without_repeats(no_docs).collect() == []


def test_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert differences(lines.op5_line_dedup(spark, sf_dir), connect(sf_dir), lines.OP5_SQL) is None
