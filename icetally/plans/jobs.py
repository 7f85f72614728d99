"""Whole jobs over folders of tables: what a scheduler calls.

Every job reads declared tables, runs the operators and writes its outputs. Increments are chosen by
key, so a job that was interrupted or run twice adds each game once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import attempts, cards, feeds, impact, onice, outcomes, plays, playtext
from ..sources import readers, sinks


def _write_new(
    spark: SparkSession, rows: DataFrame, path: str, keys: list[str], mode: str, seasons: bool = True
) -> None:
    """Write all rows, or in append mode those whose key is not stored; the first append makes the
    table. With ``seasons``, the first key begins with the year of the season and the table has a
    folder for each."""
    if mode == "append" and sinks.exists(spark, path):
        stored = readers.read_table(spark, path)
        seasons = seasons and readers.SEASON_FOLDER in stored.columns
        if seasons:
            rows = rows.withColumn(readers.SEASON_FOLDER, readers.season_of(F.col(keys[0])))
        rows = readers.incremental_rows(rows, stored, keys)
    else:
        mode, rows = "overwrite", rows.dropDuplicates(keys)
    if seasons:
        sinks.write_seasons(rows, path, keys[0], mode)
    else:
        sinks.write_table(rows, path, mode)


def ingest_games(
    spark: SparkSession, payload_path: str, page_path: str, out: str, mode: str = "overwrite"
) -> None:
    """Box scores (``id, payload``) and play pages (``game_id, html``) to raw tables and plays with
    the players on the ice. Unreadable payloads go to ``rejected`` and stop nothing."""
    # The payloads are parsed once; every table is cut from the parsed rows.
    staging = f"{sinks.shared_directory(spark)}/box-{uuid.uuid4().hex}"
    checked = feeds.checked_box_scores(readers.read_table(spark, payload_path))
    sinks.write_table(checked, staging)
    docs, rejected = feeds.readable_rows(readers.read_table(spark, staging))
    _write_new(spark, rejected, f"{out}/rejected", ["id"], mode, seasons=False)
    # Only pages and stored plays of this run's games are worked on.
    games = feeds.game_header(docs).select("game_id").distinct()
    landed_pages = readers.read_table(spark, page_path)
    pages = playtext.page_text(landed_pages.join(games, "game_id", "left_semi"))
    tokenized = playtext.tokenize_plays(feeds.plays_documents(docs, pages))
    forwards, defense, goalies = feeds.box_score_tables(docs)
    outputs = {
        "raw_plays": (playtext.raw_plays(tokenized), ["game_id", "index"]),
        "raw_forwards": (forwards, ["game_id", "playerId"]),
        "raw_defense": (defense, ["game_id", "playerId"]),
        "raw_goalies": (goalies, ["game_id", "playerId"]),
    }
    for name, (rows, keys) in outputs.items():
        _write_new(spark, rows, f"{out}/{name}", keys, mode)
    stored = {name: readers.read_table(spark, f"{out}/{name}") for name in outputs}
    # Pages whose box score hasn't landed yet are listed, to be ingested with it later.
    waiting = landed_pages.select("game_id").join(games, "game_id", "left_anti")
    done = stored["raw_forwards"].select("game_id").distinct()
    sinks.write_table(waiting.join(done, "game_id", "left_anti"), f"{out}/waiting_pages")
    # Only plays without their players yet are enriched.
    games = games.withColumn(readers.SEASON_FOLDER, readers.season_of(F.col("game_id")))
    pending, *rosters = (readers.same_seasons(stored[name], games) for name in outputs)
    pending = pending.join(games.select("game_id"), "game_id", "left_semi")
    enriched_path = f"{out}/plays_with_onice"
    if mode == "append" and sinks.exists(spark, enriched_path):
        pending = readers.incremental_rows(pending, readers.read_table(spark, enriched_path), ["game_id", "index"])
    rosters = [r.drop(readers.SEASON_FOLDER) for r in (rosters[0], rosters[1], rosters[2])]
    enriched = onice.attach_on_ice(pending.drop(readers.SEASON_FOLDER), *rosters)
    _write_new(spark, enriched, enriched_path, ["game_id", "index"], mode)
    sinks.remove(spark, staging)


def format_plays(spark: SparkSession, out: str) -> None:
    """Plays with the players on the ice to the sparse play table."""
    rows = readers.landing_table(spark, f"{out}/plays_with_onice")
    sinks.write_table(plays.sparse_union(rows), f"{out}/plays_sparse_detail")


def prepare_attempts(spark: SparkSession, source: str, target: str, buckets: int) -> None:
    """Bucketed copies of the analysis inputs."""
    for name in ("plays_sparse_detail", "raw_forwards", "raw_defense"):
        rows = readers.landing_table(spark, f"{source}/{name}")
        sinks.write_bucketed(rows, f"{target}/{name}", "game_id", buckets)


def attempt_metrics(
    spark: SparkSession, source: str, target: str, team: str | None = None, mode: str = "overwrite"
) -> None:
    """Player summary and game detail of all teams, or of one."""
    toi = attempts.skater_toi(
        readers.read_table(spark, f"{source}/raw_forwards"),
        readers.read_table(spark, f"{source}/raw_defense"),
    )
    rows = readers.read_table(spark, f"{source}/plays_sparse_detail")
    detail_path = f"{target}/team_player_game_detail"
    detail = attempts.game_detail(rows, toi, team)
    keys = ["game_id", "team", "player_id"]
    if mode == "append" and sinks.exists(spark, detail_path):
        # A team that was loaded before adds only its new games.
        detail = readers.incremental_rows(detail, readers.read_table(spark, detail_path), keys)
    sinks.write_bucketed(detail, detail_path, "player_id", name="hashed_player_id", mode=mode)
    # The summary reads the written detail, so the metrics are computed once.
    written = readers.read_table(spark, detail_path)
    if team is not None:
        written = written.where(F.col("team") == team)
    summary = attempts.team_summary(written, toi, team)
    summary_path = f"{target}/team_player_summary"
    if mode == "append":
        # A team's summary covers all of its games, so it replaces the one written before.
        sinks.write_pairs(summary, summary_path, ["team"])
    else:
        summary.hint("rebalance", F.col("team")).write.mode(mode).partitionBy("team").parquet(summary_path)


def add_attempt_games(spark: SparkSession, source: str, target: str) -> None:
    """Detail and summary of all teams after new games: their detail is computed and appended, their
    sums are stored beside those of earlier loads, and the summary is made from the sums alone.

    A load counts once its list of games is written, which is the last step, so a load that broke
    off is repeated as a whole.
    """
    state = f"{target}/summary_state"
    plays_ = readers.read_table(spark, f"{source}/plays_sparse_detail")
    toi = attempts.skater_toi(
        readers.read_table(spark, f"{source}/raw_forwards"), readers.read_table(spark, f"{source}/raw_defense")
    )
    if sinks.exists(spark, f"{state}/games"):
        done = readers.read_table(spark, f"{state}/games").select("game_id")
        plays_, toi = (rows.join(done, "game_id", "left_anti") for rows in (plays_, toi))
    load = uuid.uuid4().hex
    detail_path = f"{target}/team_player_game_detail"
    detail = attempts.game_detail(plays_, toi)
    if sinks.exists(spark, detail_path):
        keys = ["game_id", "team", "player_id"]
        detail = readers.incremental_rows(detail, readers.read_table(spark, detail_path), keys)
    sinks.write_bucketed(detail, detail_path, "player_id", name="hashed_player_id", mode="append")
    games = toi.select("game_id").unionByName(plays_.select("game_id")).distinct()
    sinks.write_table(games, f"{state}/pending-{load}")
    games = readers.read_table(spark, f"{state}/pending-{load}")
    written = readers.read_table(spark, detail_path).join(games, "game_id", "left_semi")
    parts = attempts.summary_state(written, toi)
    for rows, name in zip(parts, ("metrics", "usage")):
        rows.withColumn("load", F.lit(load)).write.mode("append").parquet(f"{state}/{name}")
    games.withColumn("load", F.lit(load)).write.mode("append").parquet(f"{state}/games")
    sinks.remove(spark, f"{state}/pending-{load}")
    loads = readers.read_table(spark, f"{state}/games").select("load").distinct()
    kept = [
        readers.read_table(spark, f"{state}/{name}").join(loads, "load", "left_semi").drop("load")
        for name in ("metrics", "usage")
    ]
    summary = attempts.summary_of_state(*attempts.merged_state(*kept))
    summary.hint("rebalance", F.col("team")).write.mode("overwrite").partitionBy("team").parquet(
        f"{target}/team_player_summary"
    )


def load_feeds(
    spark: SparkSession,
    payload_path: str,
    out: str,
    mode: str = "overwrite",
    team_path: str | None = None,
) -> None:
    """Live feeds (``id, payload``) of finished games to the all-string landing tables. Payloads that
    can't be read, or name several head coaches, go to ``rejected``. Team listings (``id, payload``)
    give the table of teams."""
    load_feed_rows(spark, readers.read_table(spark, payload_path), out, mode, team_path)


def update_feeds(
    spark: SparkSession, payload_path: str, out: str, year: str, game_type: str, team_path: str | None = None
) -> None:
    """The games of a season and type (``PR``, ``R`` or ``P``) past the last stored one, appended.
    Only that season's folder is read for the mark, and only payloads past it are parsed."""
    prefix = f"{year}{readers.SEASON_TYPES[game_type]}"
    landed = readers.read_table(spark, payload_path).where(F.col("id").startswith(prefix))
    if sinks.exists(spark, f"{out}/gameinfo"):
        gameinfo = readers.read_table(spark, f"{out}/gameinfo")
        landed = readers.after_last(landed, readers.high_water_mark(gameinfo, year, game_type))
    load_feed_rows(spark, landed, out, "append", team_path)


def load_feed_rows(
    spark: SparkSession, landed: DataFrame, out: str, mode: str, team_path: str | None = None
) -> None:
    """What ``load_feeds`` does, for payloads that were read before."""
    # The payloads are parsed once; every table is cut from the parsed rows.
    staging = f"{sinks.shared_directory(spark)}/feeds-{uuid.uuid4().hex}"
    sinks.write_table(feeds.checked_feeds(landed), staging)
    docs, rejected = feeds.readable_rows(readers.read_table(spark, staging))
    _write_new(spark, rejected, f"{out}/rejected", ["id"], mode, seasons=False)
    if team_path is not None:
        listed = sinks.stringify(feeds.teams(readers.read_table(spark, team_path)))
        _write_new(spark, listed, f"{out}/teams", ["team_id"], mode, seasons=False)
    finished = feeds.finished(docs)
    outputs = {
        "gameinfo": (feeds.game_info(finished), ["game_pk"]),
        "playerstats": (feeds.player_stats(finished), ["index_val"]),
        "playerinfo": (feeds.player_info(finished), ["index_val"]),
        "officials": (feeds.officials(finished), ["game_id", "official_id"]),
        "plays": (feeds.feed_plays(finished), ["index_val"]),
        "odd_periods": (feeds.unknown_period_types(finished), ["id"]),
    }
    for name, (rows, keys) in outputs.items():
        _write_new(spark, sinks.stringify(rows), f"{out}/{name}", keys, mode)
    sinks.remove(spark, staging)


def match_ups(spark: SparkSession, source: str, target: str) -> None:
    """Landing tables to the skater-versus-goaltender table."""
    rows = outcomes.match_up_table(
        readers.landing_table(spark, f"{source}/playerstats"),
        readers.landing_table(spark, f"{source}/gameinfo"),
    )
    sinks.write_table(rows, f"{target}/skater_vs_goaltender")


def teammate_profiles(
    spark: SparkSession,
    source: str,
    target: str,
    pairs: list[tuple[str, str]],
    alpha: float = 0.05,
    full_careers: bool = False,
) -> None:
    """Impact reports and result sentences of any number of pairs."""
    rows = readers.read_table(spark, f"{source}/skater_vs_goaltender")
    wanted = impact.player_pairs(spark, pairs)
    tenure_path = f"{target}/tenures"
    salts = impact.player_salts(rows)
    sinks.write_table(impact.tenure(impact.teammate_games(rows, wanted, salts)), tenure_path)
    # The chain of match-ups is read once for the tenures and once for the games.
    tenures = readers.read_table(spark, tenure_path)
    impact.check_tenure(tenures)
    games_path = f"{target}/tenure_games"
    games = impact.tenure_games(rows, wanted, full_careers, tenures, salts)
    sinks.write_table(games, games_path)
    report = impact.impact_report(readers.read_table(spark, games_path), alpha)
    sinks.write_reports(report, tenures, f"{target}/reports")
    sentences = impact.result_sentences(report, alpha).withColumn(
        "pair", sinks.pair_name(F.col("player_a"), F.col("player_b"))
    )
    sinks.write_pairs(sentences, f"{target}/sentences", ["pair"])


def load_cards(
    spark: SparkSession, page_path: str, out: str, gameyear: str, position: str, mode: str = "append"
) -> None:
    """Card pages (``id, html``) of one edition; pages that are no cards are listed in ``rejected``."""
    found, other = cards.card_table(readers.read_table(spark, page_path), gameyear, position)
    keys = ["player_id", "gameyear"]
    _write_new(spark, found, f"{out}/{position}s", keys, mode, seasons=False)
    _write_new(spark, other, f"{out}/rejected", keys, mode, seasons=False)
