"""What to load next, and what a run did."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECENT_DAYS = 3
SHOWN_FAILURES = 5


def games_missing_box(games: DataFrame, stats: DataFrame, season: int | None = None) -> DataFrame:
    """Finished provider-linked games without a box score."""
    wanted = games.where("status = 'final' AND provider_id IS NOT NULL")
    if season is not None:
        wanted = wanted.where(F.col("season") == season)
    return wanted.join(stats.select("game_id"), "game_id", "left_anti")


def games_missing_events(games: DataFrame, ledger: DataFrame, first: int, last: int) -> DataFrame:
    """Finished games of the seasons whose event task has not succeeded yet."""
    done = ledger.where("status = 'success'").select("task_key")
    wanted = games.where(F.col("status") == "final").where(F.col("season").between(first, last))
    keyed = wanted.withColumn("task_key", F.concat(F.lit("pbp:"), "game_id"))
    return keyed.join(done, "task_key", "left_anti").drop("task_key")


def pending(tasks: DataFrame, ledger: DataFrame, skip_if_done: bool = True) -> DataFrame:
    """Tasks to run: all, or those not yet marked as succeeded."""
    if not skip_if_done:
        return tasks
    return tasks.join(ledger.where("status = 'success'").select("task_key"), "task_key", "left_anti")


def seasons_with_events(games: DataFrame, events: DataFrame, min_games: int = 1000) -> DataFrame:
    finals = games.where("status = 'final'").join(events.select("game_id"), "game_id", "left_semi")
    return finals.groupBy("season").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_games).select("season")


def days_to_refresh(games: DataFrame, today: date, recent: int = RECENT_DAYS) -> DataFrame:
    """The last days, and earlier days of this season with an unfinished game."""
    season = today.year if today.month >= 8 else today.year - 1
    spark = games.sparkSession
    last = spark.range(1).select(F.explode(F.sequence(F.lit(today - timedelta(days=recent)), F.lit(today))).alias("day"))
    stale = games.where(
        (F.col("season") == season) & (F.col("status") != "final") & (F.col("game_date") < F.lit(today))
    ).select(F.col("game_date").alias("day"))
    return last.union(stale).distinct()


def run_summary(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome counts and the first failed tasks. Each task keeps only its first few failures
    before the shuffle, so a run with very many failures stays small."""
    n = [F.count_if(F.col("outcome") == o).alias(a) for o, a in (("success", "succeeded"), ("skipped", "skipped"), ("failed", "failed"))]
    counts = tasks.groupBy(*keys).agg(*n)
    failed = tasks.where("outcome = 'failed'")
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("task_key"))
    first = failed.withColumn("__rn", order).where(F.col("__rn") <= SHOWN_FAILURES)
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list("task_key")).alias("first_failures"))
    return counts.join(listed, keys, "left")
