"""The live path as a bounded streaming run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.catalog.base import query
from boutline.fixtures import League
from boutline.functions.prob import settle
from boutline.session import fresh_path, shuffles_of, tasks_for
from boutline.streaming.live import TASK_ROWS, LiveJob, ModelPointer, read_feed

POLLS = 3
_LOGISTIC = "1/(1+exp(-(0.15::DOUBLE*(score_home-score_away) + ln(q/(1-q))*seconds_remaining/2880)))"
_POINTS = f"""SELECT game_id, action_id, period, score_home, score_away, possession,
    CASE WHEN is_last AND score_home <> score_away THEN CASE WHEN score_home > score_away THEN 1 ELSE 0 END
      WHEN seconds_remaining <= 0 AND score_home <> score_away AND period >= 4 THEN CASE WHEN score_home > score_away THEN 1 ELSE 0 END
      ELSE {_LOGISTIC} END AS home_win_prob FROM
    (SELECT s.*, action_id = max(action_id) OVER (PARTITION BY s.game_id) AS is_last, (ok % 97 + 1)/98.0::DOUBLE AS q FROM
      (SELECT game_id, action_id, period, score_home, score_away, possession, seconds_remaining FROM states
       UNION ALL SELECT DISTINCT game_id, 0, 1, 0, 0, 0, 2880.0 FROM pbp) s JOIN games USING (game_id))"""


def logistic(states: DataFrame) -> DataFrame:
    """A fixed in-game model with the reference point at the pre-game estimate."""
    margin = F.col("score_home") - F.col("score_away")
    lead = F.log(F.col("pregame_prob") / (1 - F.col("pregame_prob"))) * F.col("seconds_remaining") / 2880
    p = 1 / (1 + F.exp(-(0.15 * margin + lead)))
    return states.withColumn("home_win_prob", settle(p, margin, F.col("seconds_remaining"), F.col("period")))


def job(L: League, name: str, source: str = "live") -> LiveJob:
    # The fixture's tracked games count as live, so the whole event table runs through the job.
    games = L.games().join(L.events().select("game_id"), "game_id", "left_semi").withColumn("status", F.lit("live"))
    root = fresh_path(L.spark, f"live/{name}")
    return LiveJob(
        L.spark,
        root,
        ModelPointer(lambda: "1", lambda: (logistic, "1")),
        lambda: games,
        lambda g: g.withColumn("pregame_prob", (F.col("ok") % 97 + 1) / 98.0),
        source,
    )


def feed_polls(L: League) -> DataFrame:
    """Every game's feed as sent at three polls, each re-sending all events so far."""
    events = L.events()
    counts = events.groupBy("game_id").agg(F.max("action_id").alias("n"))
    polls = F.explode(F.sequence(F.lit(1), F.lit(POLLS))).alias("poll")
    rows = events.join(counts, "game_id").select("*", polls).where(F.col("action_id") * POLLS <= F.col("n") * F.col("poll"))
    return rows.select(
        "game_id", "action_id", "period", "clock_seconds", "location", "action_type", "sub_type", "description",
        "score_home", "score_away", (F.col("poll") == POLLS).alias("final"), F.col("poll").cast("long").alias("arrival"),
    )


@query("x2_live_points", _POINTS, "home_win_prob")
def x2_live_points(L: League) -> DataFrame:
    """Three polls through the streaming query: each state is emitted once, the end is certain."""
    run = job(L, "x2")
    feed = feed_polls(L)
    # One write per poll, so polls arrive in order; a file holds whole games, a batch about a poll.
    tasks = tasks_for(L.spark, L.events().count(), TASK_ROWS)
    files = tasks or int(L.spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_of(tasks, L.spark):
        for poll in range(1, POLLS + 1):
            sent = feed.where(F.col("arrival") == poll).repartition(files, "game_id")
            sent.write.mode("append").parquet(f"{run.root}/feed")
    stream = read_feed(L.spark, f"{run.root}/feed", files_per_batch=files)
    running = run.start(stream, f"{run.root}/checkpoint", available_now=True)
    running.awaitTermination()
    return run.recorded().select("game_id", "action_id", "period", "score_home", "score_away", "possession", "home_win_prob")


@query("x12_replay", _POINTS, "home_win_prob")
def x12_replay(L: League) -> DataFrame:
    """All stored games through the live path at once, twice: the second run changes nothing."""
    run = job(L, "x12", "replay")
    run.replay(L.events())
    points = run.replay(L.events())
    return points.select("game_id", "action_id", "period", "score_home", "score_away", "possession", "home_win_prob")
