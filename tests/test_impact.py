import itertools
import math
import statistics

import pytest
from pyspark.sql import functions as F

from icetally.functions.significance import exact_two_sided, normal_two_sided
from icetally.operators import impact, skew


def counts(spark, with_, without, name="s"):
    rows = [(name, True, v) for v in with_] + [(name, False, v) for v in without]
    frame = spark.createDataFrame(rows, "statistic string, together boolean, value long")
    return impact.value_counts(frame, ["statistic"])


def brute_u(x, y):
    return sum((a > b) + (a == b) / 2 for a in x for b in y)


def brute_exact(x, y):
    pooled = sorted(x + y)
    u = brute_u(x, y)
    upper = max(u, len(x) * len(y) - u)
    results = []
    for chosen in itertools.combinations(range(len(pooled)), len(x)):
        a = [pooled[i] for i in chosen]
        b = [pooled[i] for i in range(len(pooled)) if i not in chosen]
        results.append(brute_u(a, b))
    return min(1.0, 2 * sum(r >= upper for r in results) / len(results))


def test_normal_tail(spark):
    zs = [0.0, 0.3, 1.0, 1.96, 3.0, 6.0, 12.0]
    frame = spark.createDataFrame([(z,) for z in zs], "z double")
    for z, row in zip(zs, frame.select(normal_two_sided(F.col("z"))).collect()):
        assert row[0] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=2e-7)


@pytest.mark.parametrize(
    "x, y",
    [([1, 5, 9, 20], [2, 3, 11, 12, 30]), ([7], [1, 2, 3, 4]), ([10, 11, 12], [1, 2, 3, 4, 5, 6])],
)
def test_exact_p_matches_enumeration(spark, x, y):
    row = impact.rank_test(counts(spark, x, y), ["statistic"], method="exact").first()
    assert row["mann_whitney_u"] == brute_u(x, y)
    assert row["p_value"] == pytest.approx(brute_exact(x, y))
    back = impact.rank_test(counts(spark, y, x), ["statistic"]).first()
    assert row["mann_whitney_u"] + back["mann_whitney_u"] == len(x) * len(y)


def test_exact_far_tails_and_edges(spark):
    rows = [(480.0, 6, 80), (480.0, 80, 6), (0.0, 6, 80), (3.0, 2, 3), (None, 2, 3), (0.0, 0, 3)]
    frame = spark.createDataFrame(rows, "u double, n1 long, n2 long")
    got = [r[0] for r in frame.select(exact_two_sided(F.col("u"), F.col("n1"), F.col("n2"))).collect()]
    assert got[:3] == [pytest.approx(2 / math.comb(86, 6), rel=1e-12)] * 3
    assert got[3:] == [1.0, None, None]


def test_exact_test_stays_in_the_engine(spark):
    tested = impact.rank_test(counts(spark, [1, 5], [2, 3, 9]), ["statistic"], method="exact")
    assert "Python" not in tested._jdf.queryExecution().executedPlan().toString()


def test_one_outlier_leaves_the_ranges_even(spark):
    values = [*range(20_000), 10**15]
    frame = spark.createDataFrame([("k", v, 1) for v in values], "key string, value long, rows long")
    running = skew.running_counts(frame, ["key"], "value", ["rows"])
    assert running.where("rows_below <> least(value, 20000)").count() == 0
    assert "_range" not in running.columns
    placed = skew.value_ranges(frame, ["key"], "value", ["rows"])
    sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 3 * sum(sizes) / len(sizes)


def test_ties_means_and_medians(spark):
    x, y = [0, 0, 1, 2, 2, 2, 5, 40], [0, 1, 1, 1, 3, 5, 5, -4, 9]
    row = impact.rank_test(counts(spark, x, y), ["statistic"]).first()
    n1, n2, n = len(x), len(y), len(x) + len(y)
    u = brute_u(x, y)
    tied = sum(c**3 - c for c in ((x + y).count(v) for v in set(x + y)))
    spread = math.sqrt(n1 * n2 / 12 * ((n + 1) - tied / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / spread
    assert row["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6)
    assert row["median_with"] == statistics.median(x)
    assert row["median_without"] == statistics.median(y)
    assert row["average_with"] == pytest.approx(statistics.mean(x))
    assert row["reject_null"] is False and row["test_result"].startswith("Fail")


def test_all_tied_and_empty(spark):
    flat = impact.rank_test(counts(spark, [3] * 5, [3] * 4), ["statistic"]).first()
    assert flat["p_value"] == 1.0
    alone = impact.rank_test(counts(spark, [1, 2], []), ["statistic"]).first()
    assert alone["p_value"] is None and alone["mann_whitney_u"] is None
    assert alone["median_without"] is None and alone["reject_null"] is False


def test_box(spark):
    x, y = [1, 2, 3, 4, 100], [5, 5, 6]
    row = impact.box_stats(counts(spark, x, y), ["statistic"]).first()
    assert (row["q1_with"], row["median_with"], row["q3_with"]) == (2, 3, 4)
    assert (row["low_with"], row["high_with"], row["outliers_with"]) == (1, 4, 1)
    assert (row["low_without"], row["high_without"], row["outliers_without"]) == (5, 6, 0)


def match_ups(spark, rows):
    """(game, side, player, goals, type); the other columns are constant."""
    frame = spark.createDataFrame(
        [(g, s, p, float(n), t) for g, s, p, n, t in rows],
        "game_pk string, player_teamtype string, player_fullname string, goals double, game_type string",
    )
    columns = set(impact.INTEGER_COLUMNS) - {"points", "standings_points", *frame.columns}
    frame = frame.withColumns({c: F.lit("1") for c in columns})
    frame = frame.withColumns({c: F.lit(0) for c in ("ot_loss", "shootout_loss", "ot_win")})
    texts = set(impact.DESCRIPTIVE_COLUMNS) - set(frame.columns)
    return frame.withColumns({c: F.col("game_pk") if c == "game_start" else F.lit("x") for c in texts})


GAMES = [
    ("2021020001", "home", "Al One", 1, "R"),
    ("2021020002", "home", "Al One", 2, "R"),
    ("2021020002", "home", "Bo Two", 0, "R"),
    ("2021020003", "away", "Al One", 3, "R"),
    ("2021020003", "home", "Bo Two", 1, "R"),  # opponents here
    ("2021020004", "away", "Bo Two", 1, "R"),
    ("2021020005", "away", "Al One", 4, "R"),
    ("2021020005", "away", "Bo Two", 2, "R"),
    ("2021020006", "away", "Al One", 9, "R"),
    ("2021030001", "away", "Al One", 9, "P"),
    ("2021030001", "away", "Bo Two", 9, "P"),
    ("2021020002", "home", "Cy Three", 7, "R"),
]


def test_tenure_and_report(spark):
    rows = match_ups(spark, GAMES)
    pairs = impact.player_pairs(spark, [("Al One", "bo two"), ("bo two", "nobody")])
    tenures = impact.tenure(impact.teammate_games(rows, pairs))
    impact.check_tenure(tenures)
    (only,) = tenures.collect()
    assert (only["game_count"], only["first_game"], only["last_game"]) == (
        2,
        "2021020002",
        "2021020005",
    )
    games = impact.tenure_games(rows, pairs)
    assert games.count() == 3 + 4
    report = {
        (r["player_last_name"], r["statistic"]): r
        for r in impact.impact_report(games).collect()
    }
    goals = report["al one", "goals"]
    assert (goals["average_with"], goals["average_without"]) == (3.0, 3.0)
    assert len(report) == 2 * 17
    everything = impact.tenure_games(rows, pairs, full_careers=True)
    assert everything.count() == 5 + 4 + 4  # the second pair keeps its games as well
    kept = impact.rejected_only(
        impact.value_counts(impact.samples(games)), impact.impact_report(games, alpha=1.1)
    )
    assert kept.count() == impact.value_counts(impact.samples(games)).count()
    named = impact.named_report(impact.impact_report(games), "Al One", "Bo Two")
    assert "average_with_two" in named.columns and named.count() == 17
    sentences = impact.result_sentences(impact.impact_report(games)).collect()
    assert len(sentences) == 2 and "faceOffWins" in sentences[0]["closing"]


def test_positions_and_running_counts(spark):
    rows = [("hot", i // 50, i) for i in range(400)] + [("cold", 0, 7), ("cold", 3, 160)]
    frame = spark.createDataFrame(rows, "key string, block int, n int")
    numbered = skew.ordered_positions(frame, {"place": ["key"]}, "block", ["n"])
    got = sorted((r["key"], r["n"], r["place"]) for r in numbered.collect())
    assert got == [("cold", 7, 1), ("cold", 160, 2)] + [("hot", i, i + 1) for i in range(400)]
    tallies = frame.groupBy("key", F.col("n").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    running = skew.running_counts(tallies, ["key"], "value", ["rows"]).collect()
    assert all(r["rows_below"] == r["value"] for r in running if r["key"] == "hot")
    assert {r["rows_all"] for r in running if r["key"] == "hot"} == {400}


def test_only_heavy_keys_are_repeated(spark):
    """One key has half of the rows, one a thirtieth, and the rest have one row each."""
    rows = [("hot", i) for i in range(3000)] + [("warm", i) for i in range(200)] + [(f"k{i}", i) for i in range(2800)]
    facts = spark.createDataFrame(rows, "key string, v int")
    salts = skew.heavy_salts(facts, ["key"])
    hashes = {r["key"]: r["h"] for r in facts.select("key", F.xxhash64("key").alias("h")).distinct().collect()}
    assert set(salts) == {hashes["hot"], hashes["warm"]} and salts[hashes["hot"]] >= 32
    lookup = spark.createDataFrame([(k, n) for n, k in enumerate(hashes)], "key string, n int")
    joined = skew.salted_join(facts, lookup, ["key"], ["v"], salts=salts)
    assert sorted(map(tuple, joined.collect())) == sorted((k, v, list(hashes).index(k)) for k, v in rows)
    plain = skew.salted_join(facts, lookup, ["key"], ["v"], salts={})
    assert plain.count() == len(rows)
    plan = made_parts(lookup, salts)
    assert plan == len(hashes) + sum(salts.values()) - len(salts)


def made_parts(lookup, salts):
    """Rows of the lookup side once each key is repeated for its salts."""
    listed = [F.lit(x) for pair in salts.items() for x in pair]
    parts = F.coalesce(F.try_element_at(F.create_map(*listed), F.xxhash64("key")), F.lit(1))
    return lookup.agg(F.sum(parts)).first()[0]
