"""Serving reads."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutline.catalog.base import query
from boutline.catalog.joining import _LATEST
from boutline.fixtures import TODAY, League
from boutline.operators.latest import latest_by
from boutline.operators.running import row_numbers
from boutline.plans import ingest, serving

_DAY = date(1999, 3, 3)


@query(
    "t1_total_order",
    "SELECT game_id, row_number() OVER (ORDER BY game_date, game_id) AS position FROM games",
)
def t1_total_order(L: League) -> DataFrame:
    return row_numbers(L.games(), [], F.unix_date("game_date"), ["game_date", "game_id"], name="position").select("game_id", "position")


@query(
    "t2_day_slate",
    f"""SELECT g.game_id, h.abbreviation AS home, a.abbreviation AS away, status, CAST(epoch(tip_time_utc) AS BIGINT) AS tip, home_score, away_score, p.home_win_prob, p.model_version, p.made_before_tip,
        row_number() OVER (ORDER BY tip_time_utc NULLS LAST, g.game_id) AS position FROM games g JOIN teams h ON h.team_id = home_team_id JOIN teams a ON a.team_id = away_team_id
        LEFT JOIN {_LATEST} p USING (game_id) WHERE game_date = DATE '1999-03-03'""",
    "home_win_prob",
)
def t2_day_slate(L: League) -> DataFrame:
    rows = serving.slate(L.games(), L.predictions(), L.snapshots(), L.teams(), _DAY)
    # One day's games: the position column only makes the order checkable.
    tip_order = Window.partitionBy("game_date").orderBy(F.asc_nulls_last("tip_time_utc"), "game_id")
    order = F.row_number().over(tip_order)
    return rows.select(
        "game_id", "home", "away", "status", F.unix_seconds("tip_time_utc").alias("tip"), "home_score", "away_score",
        "home_win_prob", "model_version", "made_before_tip", order.alias("position"),
    )


@query(
    "t3_recent_upcoming",
    """SELECT team_id, game_id, kind, rank FROM (SELECT team_id, game_id, CASE WHEN status = 'final' THEN 'recent' ELSE 'upcoming' END AS kind,
       CASE WHEN status = 'final' THEN row_number() OVER (PARTITION BY team_id, status = 'final' ORDER BY game_date DESC, game_id DESC)
         ELSE row_number() OVER (PARTITION BY team_id, status = 'final' ORDER BY game_date, game_id) END AS rank FROM tg) WHERE rank <= CASE WHEN kind = 'recent' THEN 10 ELSE 5 END""",
)
def t3_recent_upcoming(L: League) -> DataFrame:
    views = serving.team_views(L.games(), L.predictions())
    return serving.recent_and_upcoming(views).select("team_id", "game_id", "kind", "rank")


@query(
    "t5_team_ranking",
    """SELECT t.team_id, c.elo, row_number() OVER (ORDER BY coalesce(c.elo, 0) DESC, t.team_id) AS rank FROM teams t LEFT JOIN
       (SELECT team_id, coalesce(n.elo_pre, l.elo_post) AS elo FROM (SELECT team_id, arg_max(elo_post, game_date) AS elo_post FROM ratings WHERE elo_post IS NOT NULL GROUP BY 1) l
        FULL JOIN (SELECT team_id, arg_min(elo_pre, game_date) AS elo_pre FROM ratings WHERE elo_post IS NULL GROUP BY 1) n USING (team_id)) c USING (team_id)""",
    "elo",
)
def t5_team_ranking(L: League) -> DataFrame:
    return serving.team_ranking(L.teams(), L.ratings()).select("team_id", "elo", "rank")


@query(
    "t6_latest_one",
    "SELECT version, first_used FROM (SELECT model_version || '-' || (ok % 20) AS version, CAST(epoch(min(created_at)) AS BIGINT) AS first_used FROM predictions GROUP BY 1) ORDER BY first_used DESC, version DESC LIMIT 1",
)
def t6_latest_one(L: League) -> DataFrame:
    tail = (F.floor(F.col("id") / 10) % 20).cast("string")
    versions = L.predictions().groupBy(F.concat_ws("-", "model_version", tail).alias("version")).agg(F.unix_seconds(F.min("created_at")).alias("first_used"))
    return versions.orderBy(F.desc("first_used"), F.desc("version")).limit(1)


@query(
    "t7_game_detail",
    """SELECT g.game_id, p.id AS prediction_id, (SELECT count(*) FROM factors f WHERE f.id = p.id AND f.value IS NOT NULL) AS shown, f.home_elo_pre AS home_elo, f.away_travel_km AS away_travel,
       10 AS compared FROM games g JOIN features f USING (game_id) JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY created_at DESC, id DESC) AS rn FROM predictions) WHERE rn = 1) p USING (game_id)
       WHERE g.game_date = DATE '1999-03-03'""",
    "home_elo away_travel",
)
def t7_game_detail(L: League) -> DataFrame:
    games = L.games().where(F.col("game_date") == F.lit(_DAY))
    predictions = L.predictions()
    details = serving.game_details(games, predictions, L.snapshots(), L.teams(), L.features())
    newest = latest_by(predictions.select("game_id", "created_at", "id"), ["game_id"], ["created_at", "id"])

    def side(key: str, column: str) -> F.Column:
        return F.filter("comparison", lambda c: c["key"] == key)[0][column]

    return details.join(newest.select("game_id", F.col("id").alias("prediction_id")), "game_id").select(
        "game_id",
        "prediction_id",
        F.size("factors").alias("shown"),
        side("elo_pre", "home").alias("home_elo"),
        side("travel_km", "away").alias("away_travel"),
        F.size("comparison").alias("compared"),
    )


@query("w11_latest_prediction", f"SELECT game_id, id, model_version, home_win_prob FROM {_LATEST}", "home_win_prob")
def w11_latest_prediction(L: League) -> DataFrame:
    rows = L.predictions().select("game_id", "created_at", "id", "model_version", "home_win_prob")
    return latest_by(rows, ["game_id"], ["created_at", "id"]).drop("created_at")


@query(
    "w11_latest_jobs",
    "SELECT event_type AS job, event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts) DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def w11_latest_jobs(L: League) -> DataFrame:
    runs = L.table("events").select(
        F.col("event_type").alias("job"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("started_at"), F.col("event_id").alias("id")
    )
    return serving.latest_jobs(runs).select("job", "id")


@query(
    "w11_latest_monitoring",
    'SELECT event_type AS model, win AS "window", event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, win ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN \'season\' ELSE \'last_30_days\' END AS win FROM events)) WHERE rn = 1',
)
def w11_latest_monitoring(L: League) -> DataFrame:
    runs = L.table("events").select(
        F.col("event_type").alias("model"),
        F.when(F.col("user_id") % 2 == 0, "season").otherwise("last_30_days").alias("window"),
        F.col("ts").alias("run_at"),
        F.col("event_id").alias("id"),
    )
    return serving.latest_monitoring(runs).select("model", "window", "id")


@query(
    "w11_models_in_use",
    "SELECT (SELECT model_version FROM predictions ORDER BY created_at DESC, id DESC LIMIT 1) AS pregame, (SELECT model_version FROM snaps ORDER BY id DESC LIMIT 1) AS ingame",
)
def w11_models_in_use(L: League) -> DataFrame:
    used = L.predictions().select(F.col("model_version").alias("version"), F.struct("created_at", "id").alias("first_used_at"))
    return serving.models_in_use(used, L.snapshots())


@query("a13_last_action", "SELECT game_id, source, max(action_id) AS last_action FROM snaps GROUP BY 1, 2")
def a13_last_action(L: League) -> DataFrame:
    return L.snapshots().groupBy("game_id", "source").agg(F.max("action_id").alias("last_action"))


@query(
    "a14_adjacent_dates",
    "SELECT game_date, (SELECT max(game_date) FROM games p WHERE p.game_date < d.game_date) AS prev_date, (SELECT min(game_date) FROM games n WHERE n.game_date > d.game_date) AS next_date FROM (SELECT DISTINCT game_date FROM games) d",
)
def a14_adjacent_dates(L: League) -> DataFrame:
    return serving.all_adjacent_dates(L.games())


@query("a14_adjacent_of_day", "SELECT max(game_date) FILTER (WHERE game_date < DATE '2001-05-20') AS prev_date, min(game_date) FILTER (WHERE game_date > DATE '2001-05-20') AS next_date FROM games")
def a14_adjacent_of_day(L: League) -> DataFrame:
    return serving.adjacent_dates(L.games(), TODAY)


@query(
    "a16_run_summary",
    """SELECT job, count(*) FILTER (WHERE o = 'success') AS succeeded, count(*) FILTER (WHERE o = 'skipped') AS skipped, count(*) FILTER (WHERE o = 'failed') AS failed,
       array_to_string(list_sort(list(event_id ORDER BY event_id) FILTER (WHERE o = 'failed'))[1:5], ',') AS first_failures FROM
       (SELECT event_type AS job, event_id, CASE event_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'skipped' ELSE 'failed' END AS o FROM events) GROUP BY 1""",
)
def a16_run_summary(L: League) -> DataFrame:
    outcome = F.get(F.array(*[F.lit(o) for o in ("success", "skipped", "failed")]), (F.col("event_id") % 3).cast("int"))
    tasks = L.table("events").select(F.col("event_type").alias("job"), F.col("event_id").alias("task_key"), outcome.alias("outcome"))
    summary = ingest.run_summary(tasks, ["job"])
    return summary.withColumn("first_failures", F.array_join(F.transform("first_failures", lambda x: x.cast("string")), ","))
