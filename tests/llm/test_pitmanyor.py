"""The Pitman-Yor model against plain counts, exact seating odds and its own normalisation."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from icetally.llm import pitmanyor as py


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", low) if w] + [""]


def base(rows, learned):
    count = Counter(w for r in rows if learned(r) for w in words_of(r[1]))
    n, v = sum(count.values()), len(count)
    out = []
    for r in rows:
        own = words_of(r[1])
        out.append((r[0], learned(r), len(own), sum(count[w] > 0 for w in own), n,
                    sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)))
    return out


def key(row):
    return tuple((x is None, 0 if x is None else round(x, 6)) for x in row)


def check_base(got, rows, learned):
    mine = [(r["doc_id"], r["learned"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got]
    for a, b in zip(sorted(mine, key=key), sorted(base(rows, learned), key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6


@pytest.mark.parametrize("limits", [{}, {"block_tokens": 300, "slot_tokens": 400}])
def test_counts_and_base(docs, corpus, limits):
    got = py.scores(docs, F.col("doc_id") % 3 != 0, rounds=3, burn_in=1, **limits).collect()
    check_base(got, corpus, lambda r: r[0] is not None and r[0] % 3 != 0)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_blocks_and_slots_change_little(docs):
    one = {(r["doc_id"], r["n_tokens"]): r["score"] for r in py.scores(docs, F.lit(True), rounds=4).collect()}
    many = py.scores(docs, F.lit(True), rounds=4, block_tokens=200, slot_tokens=300).collect()
    for r in many:
        assert abs(one[r["doc_id"], r["n_tokens"]] - r["score"]) < 0.05 * abs(r["score"]) + 0.5


@pytest.mark.parametrize("limits", [{}, {"slot_tokens": 60, "block_tokens": 50}])
def test_probabilities_of_all_texts_sum_to_one(spark, limits):
    """All texts of up to six words, the unknown word included: nearly all texts there are, as the
    model learns from short ones."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices(["a", "b"], [3, 1], k=rnd.choice([0, 0, 0, 1, 1, 2]))), True) for i in range(120)]
    texts = [" ".join(t) for n in range(7) for t in product(["a", "b", "unseen"], repeat=n)]
    rows += [(1000 + i, t, False) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    got = py.scores(frame, F.col("learn"), **limits).where("not learned").collect()
    assert len(got) == len(texts) and 0.98 < sum(10.0 ** r["score"] for r in got) < 1.0001


def test_learned_structure_beats_the_base(spark):
    """Words that follow each other in a fixed order: pairs tell what single words can't."""
    rnd = random.Random(1)
    after = {i: rnd.sample(range(200), 3) for i in range(200)}

    def text(n):
        w = rnd.randrange(200)
        out = []
        for _ in range(n):
            out.append(f"w{w}")
            w = rnd.choice(after[w])
        return " ".join(out)

    frame = spark.createDataFrame([(i, text(80)) for i in range(400)], "doc_id long, text string")
    scored = py.scores(frame, F.col("doc_id") % 5 != 0)
    rows = {r["learned"]: r for r in py.perplexity(scored).collect()}
    assert rows[False]["perplexity"] < 5 < 100 < rows[False]["base_perplexity"]


def test_independent_words_are_no_worse_than_the_base(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    weight = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(rnd.choices(words, weight, k=60))) for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    row = [r for r in py.perplexity(py.scores(frame, F.col("doc_id") % 5 != 0, rounds=8, burn_in=4)).collect() if not r["learned"]][0]
    assert row["perplexity"] < 1.05 * row["base_perplexity"]


def test_query(spark, tmp_path, corpus):
    spark.createDataFrame(corpus, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = py.op13_pitman_yor_scores(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    learned = lambda r: r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2
    check_base(got.withColumn("learned", ~F.col("held_out")).collect(), corpus, learned)


def test_nothing_to_learn_and_no_rows(docs, no_docs):
    got = py.scores(docs, F.lit(None).cast("boolean")).collect()
    assert {(r["learned"], r["n_known"], r["train_tokens"]) for r in got} == {(False, 0, 0)}
    assert all(abs(r["score"]) < 1e-6 and abs(r["base_score"]) < 1e-9 for r in got)
    assert py.scores(no_docs, F.lit(True)).collect() == []


def table_odds(c, a, d):
    """Posterior of the number of tables of one dish with c customers: all seatings, by recursion."""
    ways = {1: a * 1.0}
    for n in range(1, c):
        nxt = {}
        for t, p in ways.items():
            nxt[t] = nxt.get(t, 0) + p * (n - d * t)
            nxt[t + 1] = nxt.get(t + 1, 0) + p * a
        ways = nxt
    total = sum(ways.values())
    return {t: p / total for t, p in ways.items()}


@pytest.mark.parametrize("c, a, d", [(2, 0.7, 0.5), (5, 1.3, 0.8), (9, 0.2, 0.3), (20, 4.0, 0.6)])
def test_gibbs_reaches_the_exact_odds(c, a, d):
    n, rng = 4000, np.random.default_rng(7)
    seats = py.Seating.at_one_table(np.full(n, c))
    seen = Counter()
    for k in range(60):
        seats = seats.sweep(np.full(n, a), d, rng)
        assert seats.tables.sum() == len(seats.sizes) and (np.add.reduceat(seats.sizes, seats.firsts()) == c).all()
        if k >= 20:
            seen.update(seats.tables.tolist())
    total = sum(seen.values())
    for t, p in table_odds(c, a, d).items():
        assert abs(seen[t] / total - p) < 0.02


def mean_tables(c, a, d):
    """As ``table_odds``, scaled at each customer."""
    tables, odds = np.arange(c + 2), np.zeros(c + 2)
    odds[1] = 1.0
    for n in range(1, c):
        odds = odds * np.maximum(n - d * tables, 0) + a * np.append(0.0, odds[:-1])
        odds /= odds.sum()
    return (odds * tables).sum()


@pytest.mark.parametrize("c, a, d", [(100, 5.0, 0.8), (1000, 2.0, 0.8), (1000, 30.0, 0.8), (1000, 300.0, 0.8), (1000, 3000.0, 0.8)])
def test_three_sweeps_seat_all_customers_of_large_dishes(c, a, d):
    """As the rounds of the query do; with 32 customers a sweep and tables for half of them at most
    these had 14, 16, 147, 486 and 531 tables instead of 7.5, 3.5, 39, 374 and 962."""
    n, rng = 400, np.random.default_rng(5)
    strength = np.full(n, a)
    seats = py.Seating.at_one_table(np.full(n, c)).opened(strength, d)
    for _ in range(3):
        seats = seats.sweep(strength, d, rng)
    assert abs(seats.tables.mean() / mean_tables(c, a, d) - 1) < 0.12


@pytest.mark.parametrize("c, a, d", [(40, 0.5, 0.8), (60, 8.0, 0.7), (50, 200.0, 0.5), (5, 1.3, 0.8)])
def test_deals_reach_the_exact_odds(c, a, d):
    n, rng, seen = 800, np.random.default_rng(9), Counter()
    seats = py.Seating.at_one_table(np.full(n, c))
    for k in range(60):
        seats = seats.sweep(np.full(n, a), d, rng, most=0, cells=5000)
        assert (np.add.reduceat(seats.sizes, seats.firsts()) == c).all()
        if k >= 20:
            seen.update(seats.tables.tolist())
    for t, p in table_odds(c, a, d).items():
        assert abs(seen[t] / sum(seen.values()) - p) < 0.02


def test_groups_are_divided_by_weight():
    rng = np.random.default_rng(2)
    length, n = np.array([1, 5, 2, 4]), np.array([7, 400_000, 0, 90_000])
    weights = np.array([0.0, 1, 2, 3, 4, 0, 1, 1, 5, 0, 0, 4])
    got = py.divided(n, weights, length, rng)
    assert np.add.reduceat(got, np.cumsum(length) - length).tolist() == n.tolist()
    assert got[0] == 7 and got[5] == got[9] == got[10] == 0
    assert np.abs(got[1:5] / 400_000 - [0.1, 0.2, 0.3, 0.4]).max() < 0.005 and abs(got[8] / 90_000 - 5 / 9) < 0.01


def test_mixed_dishes_keep_their_customers():
    rng = np.random.default_rng(3)
    customers = np.concatenate([rng.integers(1, 5, 300), [500, 70, 64, 65, 100_000]])
    seats = py.Seating.at_one_table(customers)
    strength = rng.random(len(customers)) * 3
    seats = seats.opened(strength, 0.7)
    for _ in range(3):
        seats = seats.sweep(strength, 0.7, rng)
        assert (np.add.reduceat(seats.sizes, seats.firsts()) == customers).all() and (seats.sizes > 0).all()
        customers = np.maximum(1, customers + rng.integers(-2, 4, len(customers)))
        seats = seats.grown(customers)
        assert (np.add.reduceat(seats.sizes, seats.firsts()) == customers).all() and (seats.sizes > 0).all()


def peak_mb(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_a_sweep_holds_some_dishes_at_a_time():
    rng = np.random.default_rng(1)
    customers = np.minimum(1 + rng.zipf(1.5, 300_000), 5000)
    strength = rng.random(len(customers)) * 3
    seats = py.Seating.at_one_table(customers).opened(strength, 0.7)
    assert peak_mb(lambda: seats.sweep(strength, 0.7, rng)) < 80
    swept = seats.sweep(strength, 0.7, rng)
    assert (np.add.reduceat(swept.sizes, swept.firsts()) == customers).all() and (swept.sizes > 0).all()


def test_parts_of_a_sweep_reach_the_exact_odds():
    customers = np.tile([2, 5, 9], 1500)
    seats, rng, seen = py.Seating.at_one_table(customers), np.random.default_rng(8), [Counter() for _ in range(3)]
    for k in range(60):
        seats = seats.sweep(np.full(len(customers), 1.3), 0.6, rng, cells=700)
        assert (np.add.reduceat(seats.sizes, seats.firsts()) == customers).all()
        for i in range(3) if k >= 20 else ():
            seen[i].update(seats.tables[i::3].tolist())
    for c, found in zip((2, 5, 9), seen):
        for t, p in table_odds(c, 1.3, 0.6).items():
            assert abs(found[t] / sum(found.values()) - p) < 0.02


def test_merging_a_slot_takes_few_bytes_a_pair():
    """20 blocks that ask for some 45,000 pairs each. What is kept of a pair to answer them is its count."""
    rng = np.random.default_rng(1)
    contexts, words = (np.sort(rng.integers(0, 2**63, n).astype("<u8")) for n in (20_000, 30_000))
    asks, total = [], 0
    for number in range(20):
        key = np.unique(rng.integers(0, 20_000, 50_000) << 32 | np.minimum(rng.zipf(1.3, 50_000), 29_999))
        counts = rng.integers(0, 3, len(key)).astype("<u4")
        asks.append((number, py.pack_pairs(contexts[key >> 32], words[key & 0xFFFFFFFF], counts)))
        total += len(key)
    peak = peak_mb(lambda: list(py.merge_pairs(0, {"ask": asks}, 3, contexts[5:6])))
    assert peak * 1e6 < 80 * total
    stored = {kind: data for _, kind, _, data, _ in py.merge_pairs(0, {"ask": asks}, 3, contexts[5:6])}
    assert len(stored["pairs"]) < total


def test_arrays_come_back():
    rng = np.random.default_rng(0)
    arrays = [rng.integers(0, 2**63, 50).astype("<u8"), np.empty(0, "<u4"), rng.random(7).astype("<f4"), np.array([1, 0], "<u1")]
    for a, b in zip(arrays, py.unpack(py.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()
