"""Scans, sinks and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.catalog.base import DIGITS, NUDGE, query
from boutline.fixtures import League
from boutline.functions import box, calendar, clock, display, elo, prob
from boutline.operators import upsert as merge
from boutline.operators.features import features_as_json, features_from_json, labelled, tasks_of
from boutline.operators.latest import latest_by
from boutline.operators.states import is_kept, prune_descriptions
from boutline.oracle import eastern_sql
from boutline.plans import serving
from boutline.session import dealt

# ---------------------------------------------------------------- scans and sinks


@query(
    "s7_raw_latest",
    """SELECT request_key, event_id, payload_bytes FROM
       (SELECT event_type || ':' || endpoint || ':{"season":"' || (user_id % 5) || '","type":"' || kind || '"}' AS request_key,
          event_id, length(props) AS payload_bytes, row_number() OVER (PARTITION BY event_type, endpoint, user_id % 5, kind ORDER BY ts DESC, event_id DESC) AS rn
        FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'log' ELSE 'board' END AS endpoint, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS kind FROM events)) WHERE rn = 1""",
)
def s7_raw_latest(L: League) -> DataFrame:
    raw = L.table("events")
    params = F.create_map(
        F.lit("type"),
        F.when(F.col("event_id") % 3 == 0, "a").otherwise("b"),
        F.lit("season"),
        (F.col("user_id") % 5).cast("string"),
    )
    endpoint = F.when(F.col("event_id") % 2 == 0, "log").otherwise("board")
    landed = raw.select(
        merge.request_key(F.col("event_type"), endpoint, params).alias("request_key"),
        "event_id",
        F.length("props").alias("payload_bytes"),
        "ts",
    )
    return latest_by(landed, ["request_key"], ["ts", "event_id"]).drop("ts")


@query(
    "s8_core_scan",
    "SELECT game_id, season, season_type, game_date, home_team_id, away_team_id, status, home_score, away_score, is_neutral FROM games",
)
def s8_core_scan(L: League) -> DataFrame:
    return L.games().select(
        "game_id", "season", "season_type", "game_date", "home_team_id", "away_team_id", "status",
        "home_score", "away_score", "is_neutral",
    )


@query(
    "s9_dimensions",
    """SELECT t.team_id, t.abbreviation, t.full_name, a.lat, a.lon, count(r.season) AS moved_seasons FROM teams t
       JOIN arenas a USING (team_id) LEFT JOIN relocations r USING (team_id) GROUP BY ALL""",
)
def s9_dimensions(L: League) -> DataFrame:
    moved = L.relocations().groupBy("team_id").agg(F.count(F.lit(1)).alias("moved_seasons"))
    joined = L.teams().join(L.arenas(), "team_id").join(moved, "team_id", "left")
    return joined.withColumn("moved_seasons", F.coalesce("moved_seasons", F.lit(0)))


def _stale(L: League) -> DataFrame:
    """A stored games table that misses some games and is behind on others."""
    ok = F.col("ok")
    return L.games().where(ok % 5 != 0).select(
        "game_id",
        F.when(ok % 4 == 0, "scheduled").otherwise(F.col("status")).alias("status"),
        F.when(ok % 4 != 0, F.col("home_score")).alias("home_score"),
        "tip_time_utc",
    )


def _incoming(L: League) -> DataFrame:
    ok = F.col("ok")
    return L.games().where(ok % 3 == 0).select(
        "game_id",
        F.when(ok % 9 == 0, "scheduled").otherwise(F.col("status")).alias("status"),
        F.when(ok % 9 != 0, F.col("home_score") + 1).alias("home_score"),
    )


_STALE_SQL = """(SELECT game_id, CASE WHEN ok % 4 = 0 THEN 'scheduled' ELSE status END AS status,
    CASE WHEN ok % 4 <> 0 THEN home_score END AS home_score, tip_time_utc FROM games WHERE ok % 5 <> 0)"""
_NEW_SQL = """(SELECT game_id, CASE WHEN ok % 9 = 0 THEN 'scheduled' ELSE status END AS status,
    CASE WHEN ok % 9 <> 0 THEN home_score + 1 END AS home_score FROM games WHERE ok % 3 = 0)"""


@query(
    "s10_upsert",
    f"""SELECT n.game_id, n.status, n.home_score, CAST(epoch(o.tip_time_utc) AS BIGINT) AS tip FROM {_NEW_SQL} n LEFT JOIN {_STALE_SQL} o USING (game_id)
        UNION ALL SELECT game_id, status, home_score, CAST(epoch(tip_time_utc) AS BIGINT) FROM {_STALE_SQL} WHERE game_id NOT IN (SELECT game_id FROM {_NEW_SQL})""",
)
def s10_upsert(L: League) -> DataFrame:
    merged = merge.upsert(_stale(L), _incoming(L), ["game_id"])
    return merged.select("game_id", "status", "home_score", F.unix_seconds("tip_time_utc").alias("tip"))


@query(
    "s11_guarded_upsert",
    f"""SELECT game_id, CASE WHEN o.game_id IS NULL OR (n.game_id IS NOT NULL AND (o.status <> 'final' OR n.status = 'final')) THEN n.status ELSE o.status END AS status,
        CASE WHEN o.game_id IS NULL OR (n.game_id IS NOT NULL AND (o.status <> 'final' OR n.status = 'final')) THEN n.home_score ELSE o.home_score END AS home_score
        FROM {_STALE_SQL} o FULL JOIN {_NEW_SQL} n USING (game_id)""",
)
def s11_guarded_upsert(L: League) -> DataFrame:
    return merge.upsert_games(_stale(L), _incoming(L)).select("game_id", "status", "home_score")


@query(
    "s12_upsert_box",
    """SELECT game_id, team_id, pts + CASE WHEN team_id % 2 = 0 THEN 10 ELSE 0 END AS pts, CASE WHEN team_id % 2 = 0 OR team_id % 3 <> 0 THEN minutes END AS minutes FROM stats""",
)
def s12_upsert_box(L: League) -> DataFrame:
    box_rows = L.stats().select("game_id", "team_id", "pts", "minutes")
    old = box_rows.withColumn("minutes", F.when(F.col("team_id") % 3 != 0, F.col("minutes")))
    new = box_rows.where("team_id % 2 = 0").withColumn("pts", F.col("pts") + 10)
    return merge.upsert(old, new, ["game_id", "team_id"])


@query(
    "s15_features_json",
    "SELECT game_id, 'v1' AS feature_version, home_elo_pre, away_std_net, diff_prev_net, home_streak, is_playoffs FROM features",
    "home_elo_pre away_std_net diff_prev_net home_streak",
)
def s15_features_json(L: League) -> DataFrame:
    back = features_from_json(features_as_json(L.features()))
    return back.select("game_id", "feature_version", "home_elo_pre", "away_std_net", "diff_prev_net", "home_streak", "is_playoffs")


@query(
    "s16_changed_predictions",
    """SELECT game_id, '10' AS model_version, p AS home_win_prob FROM
       (SELECT g.game_id, ((ok*37 + (ok%4)*211) % 97 + 1) / 98.0::DOUBLE + CASE WHEN ok % 6 = 0 THEN 0.00005::DOUBLE WHEN ok % 6 = 1 THEN 0.01::DOUBLE ELSE 0 END AS p FROM games g) s
       WHERE NOT EXISTS (SELECT 1 FROM predictions x WHERE x.game_id = s.game_id AND x.model_version = '10' AND abs(x.home_win_prob - s.p) < 1e-4
         AND NOT EXISTS (SELECT 1 FROM predictions y WHERE y.game_id = x.game_id AND (y.created_at, y.id) > (x.created_at, x.id)))""",
    "home_win_prob",
)
def s16_changed_predictions(L: League) -> DataFrame:
    ok = F.col("ok")
    base = ((ok * 37 + (ok % 4) * 211) % 97 + 1) / 98.0
    shift = F.when(ok % 6 == 0, 0.00005).when(ok % 6 == 1, 0.01).otherwise(0.0)
    scored = L.games().select("game_id", F.lit("10").alias("model_version"), (base + shift).alias("home_win_prob"))
    return merge.changed_predictions(scored, L.predictions())


@query(
    "s20_task_ledger",
    """SELECT task_key, CASE WHEN ok % 2 = 0 THEN CASE WHEN ok % 10 = 0 THEN 'failed' ELSE 'success' END ELSE 'failed' END AS status,
        CASE WHEN ok % 2 = 0 AND ok % 3 = 0 THEN ok % 4 + 1 WHEN ok % 2 = 0 THEN 1 ELSE ok % 4 END AS attempts FROM
       (SELECT 'pbp:' || game_id AS task_key, ok FROM games WHERE ok % 2 = 0 OR ok % 3 = 0)""",
)
def s20_task_ledger(L: League) -> DataFrame:
    key = F.concat(F.lit("pbp:"), "game_id").alias("task_key")
    ledger = L.games().where("ok % 3 = 0").select(key, F.lit("failed").alias("status"), (F.col("ok") % 4).alias("attempts"))
    marks = L.games().where("ok % 2 = 0").select(
        key, F.when(F.col("ok") % 10 == 0, "failed").otherwise("success").alias("status")
    )
    return merge.mark_tasks(ledger, marks)


# ---------------------------------------------------------------- scalar expressions


@query(
    "p1_season_type",
    """SELECT game_id, CASE pre WHEN '002' THEN 'regular' WHEN '004' THEN 'playoffs' WHEN '005' THEN 'playin' END AS season_type
       FROM (SELECT game_id, '00' || CAST(ok % 7 AS VARCHAR) AS pre FROM games) WHERE pre IN ('002', '004', '005')""",
)
def p1_season_type(L: League) -> DataFrame:
    coded = F.concat(F.lit("00"), (F.col("ok") % 7).cast("string"), F.substring("game_id", 4, 7))
    return L.games().select("game_id", calendar.season_type_of(coded).alias("season_type")).where("season_type IS NOT NULL")


@query(
    "p2_season_label",
    """SELECT game_id, CAST(season AS VARCHAR) || '-' || right('0' || CAST((season + 1) % 100 AS VARCHAR), 2) AS label,
       CASE WHEN ok % 3 = 2 THEN NULL ELSE season END AS parsed FROM games""",
)
def p2_season_label(L: League) -> DataFrame:
    label = calendar.season_label(F.col("season"))
    text = (
        F.when(F.col("ok") % 3 == 0, F.col("season").cast("string"))
        .when(F.col("ok") % 3 == 1, label)
        .otherwise(F.concat(F.col("season").cast("string"), F.lit("-77")))
    )
    return L.games().select("game_id", label.alias("label"), calendar.parse_season(text).alias("parsed"))


@query(
    "p3_season_of_date",
    """SELECT o_orderkey, CASE WHEN month(o_orderdate) >= 8 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS season FROM orders""",
)
def p3_season_of_date(L: League) -> DataFrame:
    day = F.to_date("o_orderdate")
    return L.table("orders").select("o_orderkey", calendar.season_of(day).alias("season"))


@query(
    "p4_iso_clock",
    "SELECT game_id, action_id, CASE WHEN k % 11 = 0 THEN 0.0::DOUBLE ELSE clock_seconds END AS clock_seconds FROM pbp",
    "clock_seconds",
)
def p4_iso_clock(L: League) -> DataFrame:
    c = F.col("clock_seconds")
    text = F.format_string("PT%02dM%05.2fS", F.floor(c / 60).cast("int"), c - 60 * F.floor(c / 60))
    broken = F.when(F.col("k") % 11 == 0, F.concat(text, F.lit("x"))).otherwise(text)
    return L.events().select("game_id", "action_id", clock.parse_iso_clock(broken).alias("clock_seconds"))


@query(
    "p5_display_clock",
    """SELECT game_id, action_id, CASE WHEN k % 11 = 0 THEN 0.0::DOUBLE WHEN clock_seconds >= 60 THEN floor(clock_seconds) ELSE clock_seconds END AS clock_seconds FROM pbp""",
    "clock_seconds",
)
def p5_display_clock(L: League) -> DataFrame:
    c = F.col("clock_seconds")
    minutes = F.floor(c / 60).cast("int")
    text = F.when(c >= 60, F.format_string("%d:%02d", minutes, F.floor(c - 60 * minutes).cast("int"))).otherwise(
        F.format_string("%.1f", c)
    )
    broken = F.when(F.col("k") % 11 == 0, "halftime").otherwise(text)
    return L.events().select("game_id", "action_id", clock.parse_display_clock(broken).alias("clock_seconds"))


@query(
    "p6_parse_utc",
    "SELECT game_id, CASE WHEN ok % 5 < 3 THEN CAST(epoch(tip_time_utc) AS BIGINT) END AS tip FROM games",
)
def p6_parse_utc(L: League) -> DataFrame:
    good = F.date_format("tip_time_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.when(F.col("ok") % 5 < 3, good).when(F.col("ok") % 5 == 3, "TBD").otherwise("")
    return L.games().select("game_id", F.unix_seconds(calendar.parse_utc(text)).alias("tip"))


@query(
    "p7_eastern_date",
    f"SELECT event_id, CAST({eastern_sql('ts')} AS DATE) AS eastern FROM events",
)
def p7_eastern_date(L: League) -> DataFrame:
    rows = L.table("events")
    return rows.select("event_id", calendar.eastern_date(F.col("ts")).alias("eastern"))


@query(
    "p8_status_codes",
    """SELECT game_id, CASE ok % 4 WHEN 2 THEN 'live' WHEN 3 THEN 'final' ELSE 'scheduled' END AS coded,
       CASE ok % 4 WHEN 1 THEN 'live' WHEN 2 THEN 'final' ELSE 'scheduled' END AS worded,
       CASE WHEN ok % 4 IN (2, 3) THEN home_score END AS score FROM games""",
)
def p8_status_codes(L: League) -> DataFrame:
    code = F.col("ok") % 4
    coded = calendar.numeric_status(code)
    word = F.get(F.array(*[F.lit(w) for w in ("pre", "in", "post", "delayed")]), code.cast("int"))
    return L.games().select(
        "game_id",
        coded.alias("coded"),
        calendar.text_status(word).alias("worded"),
        calendar.score_if_started(coded, F.col("home_score")).alias("score"),
    )


@query("p9_made_attempted", "SELECT game_id, team_id, fgm AS made, fga AS attempted FROM stats")
def p9_made_attempted(L: League) -> DataFrame:
    made, attempted = box.made_attempted(F.concat_ws("-", "fgm", "fga"))
    return L.stats().select("game_id", "team_id", made.alias("made"), attempted.alias("attempted"))


@query(
    "p10_minutes",
    "SELECT game_id, 240 + 25 * (greatest(4, max(period)) - 4) AS minutes FROM pbp GROUP BY 1",
)
def p10_minutes(L: League) -> DataFrame:
    return L.events().groupBy("game_id").agg(box.minutes_played(F.max("period")).alias("minutes"))


@query(
    "p13_seconds_remaining",
    "SELECT game_id, action_id, CASE WHEN period <= 4 THEN (4 - period)*720 + clock_seconds ELSE clock_seconds END AS remaining FROM pbp",
    "remaining",
)
def p13_seconds_remaining(L: League) -> DataFrame:
    left = clock.seconds_remaining(F.col("period"), F.col("clock_seconds"))
    return L.events().select("game_id", "action_id", left.cast("double").alias("remaining"))


@query(
    "p14_elapsed_seconds",
    "SELECT game_id, action_id, CASE WHEN period <= 4 THEN period*720 - clock_seconds ELSE 2880 + (period-4)*300 - clock_seconds END AS elapsed FROM pbp",
    "elapsed",
)
def p14_elapsed_seconds(L: League) -> DataFrame:
    gone = clock.elapsed_seconds(F.col("period"), F.col("clock_seconds"))
    return L.events().select("game_id", "action_id", gone.cast("double").alias("elapsed"))


@query(
    "p15_distance",
    """SELECT game_id, 2*6371.0::DOUBLE*asin(sqrt(pow(sin((radians(a.lat)-radians(h.lat))/2),2)+cos(radians(h.lat))*cos(radians(a.lat))*pow(sin((radians(a.lon)-radians(h.lon))/2),2))) AS km
       FROM games JOIN arenas h ON h.team_id = home_team_id JOIN arenas a ON a.team_id = away_team_id""",
    "km",
)
def p15_distance(L: League) -> DataFrame:
    home, away = (
        L.arenas().select(F.col("team_id").alias(f"{s}_team_id"), F.col("lat").alias(f"{s}_lat"), F.col("lon").alias(f"{s}_lon"))
        for s in ("home", "away")
    )
    joined = L.games().join(home, "home_team_id").join(away, "away_team_id")
    return joined.select("game_id", box.haversine_km(*(F.col(c) for c in ("home_lat", "home_lon", "away_lat", "away_lon"))).alias("km"))


@query("p16_game_site", "SELECT game_id, site_lat, site_lon FROM prepared", "site_lat site_lon")
def p16_game_site(L: League) -> DataFrame:
    return L.prepared().select("game_id", "site_lat", "site_lon")


@query("p17_game_flags", "SELECT game_id, is_neutral, is_playoffs FROM prepared")
def p17_game_flags(L: League) -> DataFrame:
    return L.prepared().select("game_id", "is_neutral", "is_playoffs")


@query(
    "p20_elo_scalars",
    """SELECT game_id, 1/(1+pow(10.0::DOUBLE, -(home_elo_pre + CASE WHEN is_neutral THEN 0 ELSE 100 END - away_elo_pre)/400)) AS p_home,
       0.75::DOUBLE*home_elo_pre + 376.25::DOUBLE AS regressed,
       pow(abs(home_score-away_score)+3.0::DOUBLE, 0.8::DOUBLE)/(7.5::DOUBLE+0.006::DOUBLE*(home_elo_pre-away_elo_pre)) AS multiplier
       FROM elo JOIN prepared USING (game_id) WHERE status = 'final'""",
    "p_home regressed multiplier",
)
def p20_elo_scalars(L: League) -> DataFrame:
    rows = L.rated().join(L.prepared().where("status = 'final'"), "game_id")
    home, away = F.col("home_elo_pre"), F.col("away_elo_pre")
    return rows.select(
        "game_id",
        elo.home_win_probability(home, away, F.col("is_neutral")).alias("p_home"),
        elo.regress_to_mean(home).alias("regressed"),
        elo.margin_multiplier(F.col("home_score") - F.col("away_score"), home - away).alias("multiplier"),
    )


@query(
    "p21_elo_update",
    "SELECT game_id, home_elo_post - home_elo_pre AS shift, away_elo_post - away_elo_pre AS counter_shift FROM elo WHERE home_elo_post IS NOT NULL",
    "shift counter_shift",
)
def p21_elo_update(L: League) -> DataFrame:
    rows = L.rated().join(L.prepared().where("status = 'final'"), "game_id")
    shift = elo.rating_shift(
        F.col("home_elo_pre"), F.col("away_elo_pre"), F.col("home_score") - F.col("away_score"), F.col("is_neutral")
    )
    return rows.select("game_id", shift.alias("shift")).withColumn("counter_shift", -F.col("shift"))


@query(
    "p22_clip_logit",
    """SELECT id, c AS clipped, ln(c/(1-c)) AS logit FROM (SELECT id, least(greatest(CASE WHEN id % 9 = 0 THEN 0 WHEN id % 9 = 1 THEN 1 ELSE home_win_prob END, 0.001::DOUBLE), 0.999::DOUBLE) AS c FROM predictions)""",
    "clipped logit",
)
def p22_clip_logit(L: League) -> DataFrame:
    p = F.when(F.col("id") % 9 == 0, 0.0).when(F.col("id") % 9 == 1, 1.0).otherwise(F.col("home_win_prob"))
    return L.predictions().select("id", prob.clip(p).alias("clipped"), prob.logit(p).alias("logit"))


@query(
    "p23_state_inputs",
    """SELECT game_id, action_id, CAST(m AS DOUBLE) AS score_diff, t AS seconds_remaining, m / sqrt(t + 1) AS diff_per_sqrt_time, CAST(possession AS DOUBLE) AS possession,
       lg AS pregame_logit, lg*t/2880 AS pregame_logit_x_time, CAST(period AS DOUBLE) AS period FROM
       (SELECT *, score_home - score_away AS m, greatest(seconds_remaining, 0) AS t, ln(q/(1-q)) AS lg FROM
        (SELECT s.*, (user_id % 97 + 1)/98.0::DOUBLE AS q FROM states s))""",
    "score_diff seconds_remaining diff_per_sqrt_time pregame_logit pregame_logit_x_time",
)
def p23_state_inputs(L: League) -> DataFrame:
    users = L.events().select("game_id", "user_id").distinct()
    rows = L.states().join(users, "game_id")
    inputs = prob.state_inputs((F.col("user_id") % 97 + 1) / 98.0)
    return rows.select("game_id", "action_id", *[e.alias(n) for n, e in inputs.items()])


@query(
    "p24_certainty",
    """SELECT id, CASE WHEN rem <= 0 AND score_home <> score_away AND period >= 4 THEN CASE WHEN score_home > score_away THEN 1 ELSE 0 END ELSE home_win_prob END AS p FROM
       (SELECT *, CASE WHEN action_id % 5 = 0 THEN 0 ELSE 1 END AS rem FROM snaps)""",
    "p",
)
def p24_certainty(L: League) -> DataFrame:
    remaining = F.when(F.col("action_id") % 5 == 0, 0).otherwise(1)
    settled = prob.settle(F.col("home_win_prob"), F.col("score_home") - F.col("score_away"), remaining, F.col("period"))
    return L.snapshots().select("id", settled.alias("p"))


@query(
    "p25_made_before_tip",
    """SELECT p.id, CASE WHEN tip_time_utc IS NOT NULL THEN created_at < tip_time_utc
         ELSE CAST(created_at - to_hours(CASE WHEN created_at >= second_sunday_march AND created_at < first_sunday_november THEN 4 ELSE 5 END) AS DATE) < game_date END AS before_tip FROM
       (SELECT *, apr + CAST((7 - dayofweek(apr)) % 7 AS INTEGER) + to_hours(7) AS second_sunday_march, oct - CAST(dayofweek(oct) AS INTEGER) + to_hours(6) AS first_sunday_november FROM
        (SELECT *, make_date(year(created_at), 4, 1) AS apr, make_date(year(created_at), 10, 31) AS oct FROM predictions JOIN games USING (game_id, ok))) p""",
)
def p25_made_before_tip(L: League) -> DataFrame:
    rows = L.predictions().join(L.games().select("game_id", "tip_time_utc", "game_date"), "game_id")
    before = calendar.made_before_tip(F.col("created_at"), F.col("tip_time_utc"), F.col("game_date"))
    return rows.select("id", before.alias("before_tip"))


@query(
    "p26_feature_label",
    """SELECT id, i, CASE i WHEN 0 THEN h.abbreviation || ' Elo rating' WHEN 1 THEN 'Net rating difference' ELSE a.abbreviation || ' days of rest' END AS label
       FROM factors f JOIN games g USING (game_id) JOIN teams h ON h.team_id = home_team_id JOIN teams a ON a.team_id = away_team_id""",
)
def p26_feature_label(L: League) -> DataFrame:
    named = serving.with_teams(L.games(), L.teams()).select("game_id", "home", "away")
    # Joined as predictions, so that a game's names meet one row of a prediction and not one of each factor.
    tasks = tasks_of(L.games())
    listed = dealt(L.predictions().select("id", "game_id", F.col("factors.feature").alias("features")), tasks, "game_id")
    listed = listed.join(dealt(named, tasks, "game_id"), "game_id")
    exploded = listed.select("id", "home", "away", F.posexplode("features").alias("i", "feature"))
    label = display.feature_label(F.col("feature"), F.col("home"), F.col("away"))
    return exploded.select("id", "i", label.alias("label"))


@query(
    "p27_display",
    """SELECT game_id, floor(p*100+0.5)::BIGINT AS home_pct, 100 - floor(p*100+0.5)::BIGINT AS away_pct,
       CASE WHEN home_std_net IS NULL THEN '—' ELSE printf('%.1f', home_std_net + sign(home_std_net)*1e-9::DOUBLE) END AS net_text,
       CASE WHEN diff_win_pct IS NULL THEN '—' ELSE CASE WHEN diff_win_pct > 0 THEN '+' ELSE '' END || printf('%.1f', (diff_win_pct + sign(diff_win_pct)*1e-9::DOUBLE)*100) || '%' END AS win_text,
       CASE WHEN home_b2b <> 0 THEN 'Yes' ELSE 'No' END AS b2b_text, CAST(floor(home_rest_days+0.5)::BIGINT AS VARCHAR) AS rest_text
       FROM (SELECT f.*, ((ok*37) % 97 + 1)/98.0::DOUBLE AS p FROM features f JOIN games g USING (game_id))""",
)
def p27_display(L: League) -> DataFrame:
    rows = L.features().join(L.games().select("game_id", "ok"), "game_id")
    home, away = display.split_percents(((F.col("ok") * 37) % 97 + 1) / 98.0)

    def text(name: str) -> F.Column:
        # Off exact halves, where one-digit formatting differs between engines.
        return display.feature_value(F.lit(name), F.col(name) + F.signum(name) * 1e-9)

    return rows.select(
        "game_id",
        home.alias("home_pct"),
        away.alias("away_pct"),
        text("home_std_net").alias("net_text"),
        text("diff_win_pct").alias("win_text"),
        text("home_b2b").alias("b2b_text"),
        text("home_rest_days").alias("rest_text"),
    )


@query(
    "p27_game_clock",
    """SELECT game_id, action_id, CASE WHEN period <= 4 THEN 'Q' || CAST(period AS VARCHAR) ELSE 'OT' END || ' ' ||
       CASE WHEN clock_seconds < 60 AND clock_seconds <> floor(clock_seconds) THEN printf('%.1f', clock_seconds)
         ELSE CAST(CAST(ceil(clock_seconds) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(ceil(clock_seconds) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS shown FROM pbp""",
)
def p27_game_clock(L: League) -> DataFrame:
    return L.events().select("game_id", "action_id", display.game_clock(F.col("period"), F.col("clock_seconds")).alias("shown"))


@query(
    "p27_dates",
    """SELECT game_id, CASE WHEN tip_time_utc IS NULL THEN 'Time TBD' ELSE ltrim(strftime(timezone('America/New_York', timezone('UTC', tip_time_utc)), '%I:%M %p'), '0') || ' ET' END AS tip,
       strftime(game_date, '%A, %B %-d') AS long_date, strftime(game_date, '%b %-d') AS short_date, strftime(game_date, '%b %-d, %Y') AS dated FROM games""",
)
def p27_dates(L: League) -> DataFrame:
    day = F.col("game_date")
    return L.games().select(
        "game_id",
        display.tip_time(F.col("tip_time_utc")).alias("tip"),
        display.long_date(day).alias("long_date"),
        display.short_date(day).alias("short_date"),
        display.short_date(day, True).alias("dated"),
    )


@query(
    "p28_noise_filter",
    "SELECT game_id, action_id, action_type FROM pbp WHERE coalesce(action_type, '') NOT IN ('Substitution', 'Timeout', 'Instant Replay')",
)
def p28_noise_filter(L: League) -> DataFrame:
    return L.events().where(is_kept(F.col("action_type"))).select("game_id", "action_id", "action_type")


@query(
    "p29_prune_text",
    "SELECT game_id, action_id, CASE WHEN action_type = 'Free Throw' THEN substr(description, 1, 4) END AS description FROM pbp",
)
def p29_prune_text(L: League) -> DataFrame:
    return prune_descriptions(L.events()).select("game_id", "action_id", "description")


_COMPARED = [
    ("elo_pre", "true"), ("win_pct", "true"), ("std_net", "true"), ("std_ortg", "true"), ("std_drtg", "false"),
    ("l10_net", "true"), ("std_pace", "true"), ("prev_net", "true"), ("rest_days", "true"), ("travel_km", "false"),
]


@query(
    "p30_comparison",
    "SELECT *, CASE WHEN home IS NULL OR away IS NULL OR round(home, 6) = round(away, 6) THEN NULL WHEN (home > away) = higher_is_better THEN 'home' ELSE 'away' END AS better FROM ("
    + " UNION ALL ".join(
        f"SELECT game_id, '{k}' AS key, home_{k} AS home, away_{k} AS away, {b} AS higher_is_better FROM features" for k, b in _COMPARED
    )
    + ")",
    "home away",
)
def p30_comparison(L: League) -> DataFrame:
    # Ratings agree across engines to six digits, so ties are judged on six digits here.
    names = [f"{s}_{k}" for s in ("home", "away") for k, _ in _COMPARED]
    rounded = L.features().select("game_id", *[F.round(F.col(n) + NUDGE, DIGITS).alias(n) for n in names])
    return serving.comparison(rounded).drop("label")


@query(
    "p31_shown_factors",
    """SELECT id, rank, feature, value, contribution, CASE WHEN contribution > 0 THEN 'home' ELSE 'away' END AS favors FROM
       (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS rank FROM factors WHERE value IS NOT NULL) WHERE rank <= 5""",
    "value contribution",
)
def p31_shown_factors(L: League) -> DataFrame:
    named = serving.with_teams(L.games(), L.teams()).select("game_id", "home", "away")
    shown = L.predictions().join(named, "game_id").withColumn("shown", serving.shown_factors())
    rows = shown.select("id", F.posexplode("shown").alias("pos", "f"))
    return rows.select("id", (F.col("pos") + 1).alias("rank"), "f.feature", "f.value", "f.contribution", "f.favors")


@query("p32_labelled", "SELECT game_id, home_win FROM features WHERE status = 'final' AND season >= 1996")
def p32_labelled(L: League) -> DataFrame:
    return labelled(L.features(), 1996).select("game_id", "home_win")


@query(
    "p33_team_view",
    """SELECT g.game_id, team_id, team_id = home_team_id AS is_home, CASE WHEN team_id = home_team_id THEN away_team_id ELSE home_team_id END AS opponent,
       CASE WHEN team_id = home_team_id THEN home_score ELSE away_score END AS team_score,
       CASE WHEN team_id = home_team_id THEN home_win_prob ELSE 1 - home_win_prob END AS win_prob
       FROM games g JOIN teams ON team_id IN (home_team_id, away_team_id) JOIN
       (SELECT game_id, home_win_prob FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY created_at DESC, id DESC) AS rn FROM predictions) WHERE rn = 1) p USING (game_id)""",
    "win_prob",
)
def p33_team_view(L: League) -> DataFrame:
    rows = serving.team_views(L.games(), L.predictions())
    return rows.select("game_id", "team_id", "is_home", F.col("opp_id").alias("opponent"), F.col("score").alias("team_score"), "win_prob")


@query(
    "p34_chart_rows",
    """SELECT id, action_id FROM (SELECT *, row_number() OVER (PARTITION BY game_id, source ORDER BY action_id, id) AS a,
       row_number() OVER (PARTITION BY game_id, source ORDER BY action_id DESC, id DESC) AS z FROM snaps) WHERE a = 1 OR z = 1 OR clock_seconds = 0""",
)
def p34_chart_rows(L: League) -> DataFrame:
    return serving.chart_rows(L.snapshots()).select("id", "action_id")


