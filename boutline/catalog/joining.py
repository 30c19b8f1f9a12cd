"""Joins of games, events, predictions and feeds."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.catalog.base import query
from boutline.fixtures import TODAY, League
from boutline.functions import calendar
from boutline.functions.calendar import board_days
from boutline.operators import upsert as merge
from boutline.operators.latest import attach_latest, latest_by
from boutline.oracle import eastern_sql
from boutline.plans import ingest, scoring, serving

_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY created_at DESC, id DESC) AS rn FROM predictions) WHERE rn = 1)"


@query(
    "j6_team_lookup",
    "SELECT game_id, h.abbreviation AS home, a.abbreviation AS away FROM games JOIN teams h ON h.team_id = home_team_id JOIN teams a ON a.team_id = away_team_id",
)
def j6_team_lookup(L: League) -> DataFrame:
    return serving.with_teams(L.games(), L.teams()).select("game_id", "home", "away")


@query(
    "j7_lateral_latest",
    """SELECT g.game_id, p.home_win_prob, p.model_version, l.home_win_prob AS live_prob, l.action_id AS live_action FROM
       (SELECT *, CASE WHEN ok % 2 = 0 THEN 'live' ELSE status END AS st FROM games) g
       LEFT JOIN LATERAL (SELECT * FROM predictions p WHERE p.game_id = g.game_id ORDER BY created_at DESC, id DESC LIMIT 1) p ON true
       LEFT JOIN LATERAL (SELECT * FROM snaps l WHERE l.game_id = g.game_id AND l.source = 'live' AND g.st = 'live' ORDER BY action_id DESC, id DESC LIMIT 1) l ON true""",
    "home_win_prob live_prob",
)
def j7_lateral_latest(L: League) -> DataFrame:
    games = L.games().withColumn("status", F.when(F.col("ok") % 2 == 0, "live").otherwise(F.col("status")))
    rows = attach_latest(games, L.predictions(), ["game_id"], ["created_at", "id"], ["home_win_prob", "model_version"])
    live = L.snapshots().where("source = 'live'").join(games.where("status = 'live'").select("game_id"), "game_id", "left_semi")
    renamed = live.select("game_id", "action_id", "id", F.col("home_win_prob").alias("live_prob"), F.col("action_id").alias("live_action"))
    joined = attach_latest(rows, renamed, ["game_id"], ["action_id", "id"], ["live_prob", "live_action"])
    return joined.select("game_id", "home_win_prob", "model_version", "live_prob", "live_action")


@query(
    "j8_target_games",
    """SELECT game_id, game_date, CASE WHEN ok % 5 = 0 THEN NULL WHEN ok % 5 = 1 THEN 'v0' ELSE 'v1' END AS feature_version,
       ok % 5 IN (0, 1) AS stale FROM games WHERE game_date BETWEEN DATE '2001-05-20' AND DATE '2001-07-01' AND status = 'scheduled'""",
)
def j8_target_games(L: League) -> DataFrame:
    ok = F.col("ok")
    stored = L.games().where(ok % 5 != 0).select("game_id", F.when(ok % 5 == 1, "v0").otherwise("v1").alias("feature_version"))
    rows = scoring.target_games(L.games(), stored, TODAY, date(2001, 7, 1), True, "v1")
    return rows.select("game_id", "game_date", "feature_version", "stale")


@query(
    "j9_missing_box",
    "SELECT game_id, provider_id FROM games g WHERE status = 'final' AND provider_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stats s WHERE s.game_id = g.game_id)",
)
def j9_missing_box(L: League) -> DataFrame:
    return ingest.games_missing_box(L.games(), L.stats()).select("game_id", "provider_id")


@query(
    "j9_missing_events",
    "SELECT game_id FROM games WHERE status = 'final' AND season BETWEEN 1996 AND 1998 AND NOT (ok % 3 = 0 AND ok % 6 = 0)",
)
def j9_missing_events(L: League) -> DataFrame:
    ledger = L.games().where("ok % 3 = 0").select(
        F.concat(F.lit("pbp:"), "game_id").alias("task_key"),
        F.when(F.col("ok") % 6 == 0, "success").otherwise("failed").alias("status"),
    )
    return ingest.games_missing_events(L.games(), ledger, 1996, 1998).select("game_id")


@query(
    "j10_seasons_with_events",
    "SELECT season FROM games WHERE status = 'final' AND game_id IN (SELECT game_id FROM pbp) GROUP BY 1 HAVING count(*) >= 20",
)
def j10_seasons_with_events(L: League) -> DataFrame:
    return ingest.seasons_with_events(L.games(), L.events(), 20)


_FEED = """(SELECT CASE WHEN ok % 11 = 0 THEN 'x' || ok ELSE 'e' || ok END AS provider_id, CASE WHEN ok % 13 = 0 THEN game_date + 3000 ELSE game_date END AS game_date, home_team_id, away_team_id FROM games)"""


@query(
    "j12_resolve_ids",
    f"""SELECT f.provider_id, coalesce(l.game_id, m.game_id, 'new-' || f.provider_id) AS game_id FROM {_FEED} f LEFT JOIN games l ON l.provider_id = f.provider_id
        LEFT JOIN games m ON m.provider_id IS NULL AND m.game_date = f.game_date AND m.home_team_id = f.home_team_id AND m.away_team_id = f.away_team_id""",
)
def j12_resolve_ids(L: League) -> DataFrame:
    ok = F.col("ok")
    feed = L.games().select(
        F.concat(F.when(ok % 11 == 0, "x").otherwise("e"), ok.cast("string")).alias("provider_id"),
        F.when(ok % 13 == 0, F.date_add("game_date", 3000)).otherwise(F.col("game_date")).alias("game_date"),
        "home_team_id",
        "away_team_id",
    )
    return merge.resolve_ids(feed, L.games(), "new-").select("provider_id", "game_id")


@query(
    "j13_label_states",
    "SELECT s.game_id, s.action_id, CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS home_win, home_win_prob AS pregame_prob FROM states s JOIN games g ON g.game_id = s.game_id AND g.status = 'final' JOIN "
    + _LATEST
    + " p ON p.game_id = s.game_id WHERE p.model_version = '10'",
    "pregame_prob",
)
def j13_label_states(L: League) -> DataFrame:
    latest = latest_by(L.predictions().drop("factors", "made_before_tip"), ["game_id"], ["created_at", "id"]).where("model_version = '10'")
    outcome = L.games().where("status = 'final'").select("game_id", (F.col("home_score") > F.col("away_score")).cast("int").alias("home_win"))
    rows = L.states().join(latest.select("game_id", F.col("home_win_prob").alias("pregame_prob")), "game_id").join(outcome, "game_id")
    return rows.select("game_id", "action_id", "home_win", "pregame_prob")


def _board(L: League) -> DataFrame:
    ok = F.col("ok")
    return L.games().where(ok % 2 == 0).select(
        F.when(ok % 22 == 0, F.concat(F.lit("z"), "game_id")).otherwise(F.col("game_id")).alias("game_id"),
        F.when(ok % 6 == 0, "final").when(ok % 6 == 2, "live").otherwise("scheduled").alias("status"),
        (ok % 120).alias("home_score"),
        (ok % 110).alias("away_score"),
    )


@query("j14_known_games", "SELECT game_id FROM games WHERE ok % 2 = 0 AND ok % 22 <> 0")
def j14_known_games(L: League) -> DataFrame:
    return _board(L).join(L.games().select("game_id"), "game_id", "left_semi").select("game_id")


@query(
    "j15_scoreboard_update",
    """SELECT game_id, CASE WHEN hit THEN CASE WHEN ok % 6 = 0 THEN 'final' ELSE 'live' END ELSE status END AS status,
       CASE WHEN hit THEN ok % 120 ELSE home_score END AS home_score, CASE WHEN hit THEN ok % 110 ELSE away_score END AS away_score
       FROM (SELECT *, ok % 2 = 0 AND ok % 22 <> 0 AND ok % 6 IN (0, 2) AND status <> 'final' AS hit FROM games)""",
)
def j15_scoreboard_update(L: League) -> DataFrame:
    games = L.games().select("game_id", "status", "home_score", "away_score")
    return merge.update_from_scoreboard(games, _board(L))


@query(
    "j17_preferred_series",
    "SELECT id, source FROM snaps s WHERE source = 'live' OR NOT EXISTS (SELECT 1 FROM snaps l WHERE l.game_id = s.game_id AND l.source = 'live')",
)
def j17_preferred_series(L: League) -> DataFrame:
    return serving.preferred_series(L.snapshots()).select("id", "source")


@query(
    "x14_live_series",
    """SELECT s.game_id, s.source, s.action_id, s.score_home, s.score_away, s.home_win_prob FROM snaps s
       WHERE s.source = (SELECT source FROM snaps c WHERE c.game_id = s.game_id GROUP BY source ORDER BY (source = 'live') DESC LIMIT 1)""",
    "home_win_prob",
)
def x14_live_series(L: League) -> DataFrame:
    rows = serving.preferred_series(L.snapshots())
    return rows.select("game_id", "source", "action_id", "score_home", "score_away", "home_win_prob")


@query(
    "j18_merge_points",
    """SELECT game_id, action_id, home_win_prob FROM (SELECT *, row_number() OVER (PARTITION BY game_id, action_id ORDER BY arrival DESC) AS rn FROM
       (SELECT game_id, action_id, home_win_prob, 1 AS arrival FROM snaps WHERE source = 'live' AND action_id <= 40
        UNION ALL SELECT game_id, action_id, 1 - home_win_prob, 2 FROM snaps WHERE source = 'live' AND action_id >= 30
        UNION ALL SELECT game_id, action_id, 0.5::DOUBLE, 3 FROM snaps WHERE source = 'live' AND action_id % 10 = 0)) WHERE rn = 1""",
    "home_win_prob",
)
def j18_merge_points(L: League) -> DataFrame:
    live = L.snapshots().where("source = 'live'").select("game_id", "action_id", "home_win_prob")
    snapshot = live.where("action_id <= 40").withColumn("arrival", F.lit(1))
    second = live.where("action_id >= 30").select("game_id", "action_id", (1 - F.col("home_win_prob")).alias("home_win_prob"), F.lit(2).alias("arrival"))
    third = live.where("action_id % 10 = 0").select("game_id", "action_id", F.lit(0.5).alias("home_win_prob"), F.lit(3).alias("arrival"))
    return merge.merge_points(snapshot, second.unionByName(third)).drop("arrival")


@query(
    "j19_pregame_estimate",
    f"""SELECT g.game_id, coalesce(p.home_win_prob, 1/(1+pow(10.0::DOUBLE, -(f.home_elo_pre + CASE WHEN f.is_neutral = 1 THEN 0 ELSE 100 END - f.away_elo_pre)/400)), 0.5::DOUBLE) AS pregame_prob
        FROM games g LEFT JOIN (SELECT * FROM {_LATEST} WHERE id % 3 <> 0) p ON p.game_id = g.game_id LEFT JOIN (SELECT * FROM features WHERE home_team_id % 5 <> 0) f ON f.game_id = g.game_id""",
    "pregame_prob",
)
def j19_pregame_estimate(L: League) -> DataFrame:
    known = latest_by(L.predictions().select("game_id", "created_at", "id", "home_win_prob"), ["game_id"], ["created_at", "id"]).where("id % 3 <> 0")
    features = L.features().where("home_team_id % 5 <> 0")
    return scoring.pregame_estimates(L.games(), known, features).select("game_id", "pregame_prob")


@query(
    "u2_days_to_refresh",
    """SELECT DISTINCT day FROM (SELECT DATE '2001-05-20' - CAST(n AS INTEGER) AS day FROM range(4) t(n)
       UNION ALL SELECT game_date FROM games WHERE season = 2000 AND status <> 'final' AND game_date < DATE '2001-05-20')""",
)
def u2_days_to_refresh(L: League) -> DataFrame:
    return ingest.days_to_refresh(L.games(), TODAY)


@query(
    "x8_board_days",
    f"""SELECT event_id, unnest(CASE WHEN hour(local) < 4 THEN [CAST(local AS DATE), CAST(local AS DATE) - 1] ELSE [CAST(local AS DATE)] END) AS day
       FROM (SELECT event_id, {eastern_sql('ts')} AS local FROM events)""",
)
def x8_board_days(L: League) -> DataFrame:
    return L.table("events").select("event_id", F.explode(board_days(F.col("ts"))).alias("day"))
