"""Joins over team rows, windows, ratings, states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.catalog.base import query
from boutline.fixtures import SHARED_SITE, League
from boutline.functions import elo
from boutline.functions.box import COMPONENTS, rates
from boutline.operators import ratings as rate
from boutline.operators.asof import asof_backward
from boutline.operators.features import DIFF_FEATURES, MODEL_FEATURES, build_features, tasks_of, team_features
from boutline.operators.form import attach_state, by_team, post_game_state, previous_season, schedule_load
from boutline.operators.retention import drop_old, thin
from boutline.operators.running import cut_by_range, running
from boutline.operators.states import forward_fill_scores, states_with_tip_off, training_states
from boutline.operators.teamgames import pair_opponents, team_games, team_games_with_box
from boutline.oracle import PER_TEAM, STD, rates_sql
from boutline.plans import serving

_POSS = "((fga+opp_fga-oreb-opp_oreb+tov+opp_tov+0.44::DOUBLE*(fta+opp_fta))/2)"


def _rows(L: League) -> DataFrame:
    narrow = L.prepared().select(
        "game_id", "season", "game_date", "status", "site_lat", "site_lon", "home_team_id", "away_team_id",
        "home_score", "away_score",
    )
    tasks = tasks_of(L.games())
    return by_team(team_games_with_box(narrow, L.stats(), tasks), tasks)


def _state(L: League, wanted: dict[str, list[str]] | None = None) -> DataFrame:
    return post_game_state(_rows(L), wanted).where("has_state")


@query("u1_team_games", "SELECT game_id, team_id, opp_id, is_home, score, opp_score, CASE WHEN status = 'final' THEN CASE WHEN score > opp_score THEN 1 ELSE 0 END END AS win FROM tg")
def u1_team_games(L: League) -> DataFrame:
    return team_games(L.games()).select("game_id", "team_id", "opp_id", "is_home", "score", "opp_score", "win")


@query(
    "j1_opponent_box",
    f"SELECT game_id, team_id, {', '.join(COMPONENTS)} FROM box",
)
def j1_opponent_box(L: League) -> DataFrame:
    return pair_opponents(L.stats()).select("game_id", "team_id", *COMPONENTS)


@query("p18_possessions", f"SELECT game_id, team_id, {_POSS} AS poss FROM box", "poss")
def p18_possessions(L: League) -> DataFrame:
    return pair_opponents(L.stats()).select("game_id", "team_id", "poss")


@query(
    "p19_rates",
    "SELECT game_id, team_id, " + ", ".join(f"{e} AS {n}" for n, e in rates_sql().items()) + " FROM box",
    " ".join(rates_sql()),
)
def p19_rates(L: League) -> DataFrame:
    return pair_opponents(L.stats()).select("game_id", "team_id", *[e.alias(n) for n, e in rates().items()])


@query("j2_played_with_box", "SELECT game_id, team_id, win FROM played")
def j2_played_with_box(L: League) -> DataFrame:
    return _state(L, {}).select("game_id", "team_id", "win")


@query(
    "w1_season_sums",
    "SELECT game_id, team_id, " + ", ".join(f"{e} AS std_{n}" for n, e in rates_sql("std_").items()) + " FROM sums",
    " ".join(f"std_{n}" for n in STD),
)
def w1_season_sums(L: League) -> DataFrame:
    return _state(L, {"std": STD}).select("game_id", "team_id", *[f"std_{n}" for n in STD])


@query(
    "w2_rolling_sums",
    "SELECT game_id, team_id, "
    + ", ".join(f"{rates_sql(f'{w}_')[n]} AS {w}_{n}" for w in ("l10", "l5") for n in ("net", "pace", "efg", "orb_pct"))
    + " FROM sums",
    " ".join(f"{w}_{n}" for w in ("l10", "l5") for n in ("net", "pace", "efg", "orb_pct")),
)
def w2_rolling_sums(L: League) -> DataFrame:
    wanted = ["net", "pace", "efg", "orb_pct"]
    state = _state(L, {"l10": wanted, "l5": wanted})
    return state.select("game_id", "team_id", *[f"{w}_{n}" for w in ("l10", "l5") for n in wanted])


@query("w3_record", "SELECT game_id, team_id, games_played, win_pct FROM state", "games_played win_pct")
def w3_record(L: League) -> DataFrame:
    return _state(L, {}).select("game_id", "team_id", "games_played", "win_pct")


@query("w4_streak", "SELECT game_id, team_id, streak FROM state", "streak")
def w4_streak(L: League) -> DataFrame:
    return _state(L, {}).select("game_id", "team_id", "streak")


@query(
    "j3_asof_state",
    "SELECT game_id, team_id, games_played, win_pct, streak, std_net, l10_net, l5_net FROM attached",
    "games_played win_pct streak std_net l10_net l5_net",
)
def j3_asof_state(L: League) -> DataFrame:
    rows = attach_state(post_game_state(_rows(L)))
    return rows.select("game_id", "team_id", "games_played", "win_pct", "streak", "std_net", "l10_net", "l5_net")


@query(
    "j3_asof_general",
    "SELECT t.game_id, t.team_id, s.game_date AS state_date, s.std_net FROM tg t ASOF LEFT JOIN state s ON t.team_id = s.team_id AND t.game_date > s.game_date",
    "std_net",
)
def j3_asof_general(L: League) -> DataFrame:
    state = _state(L, {"std": ["net"]}).select("team_id", "game_date", "std_net")
    state = state.withColumn("state_date", F.col("game_date"))
    left = team_games(L.games()).select("game_id", "team_id", "game_date")
    return asof_backward(left, state, ["team_id"], "game_date", ["state_date", "std_net"]).drop("game_date")


@query(
    "j4_previous_season",
    "SELECT tg.game_id, tg.team_id, prev_net FROM tg LEFT JOIN season_end e ON e.team_id = tg.team_id AND e.season = tg.season - 1",
    "prev_net",
)
def j4_previous_season(L: League) -> DataFrame:
    return previous_season(post_game_state(_rows(L), {"std": ["net"]})).select("game_id", "team_id", "prev_net")


@query(
    "a15_season_end",
    "SELECT team_id, season, prev_net AS closing_net FROM season_end",
    "closing_net",
)
def a15_season_end(L: League) -> DataFrame:
    state = _state(L, {"std": ["net"]}).where("std_net IS NOT NULL")
    return state.groupBy("team_id", "season").agg(F.max_by("std_net", "day").alias("closing_net"))


@query("w5_rest", "SELECT game_id, team_id, rest_days, b2b FROM load", "rest_days b2b")
def w5_rest(L: League) -> DataFrame:
    return schedule_load(by_team(team_games(L.prepared()), tasks_of(L.games()))).select("game_id", "team_id", "rest_days", "b2b")


@query("w6_games_last7", "SELECT game_id, team_id, games_last7 FROM load7", "games_last7")
def w6_games_last7(L: League) -> DataFrame:
    return schedule_load(by_team(team_games(L.prepared()), tasks_of(L.games()))).select("game_id", "team_id", "games_last7")


@query("w7_travel", "SELECT game_id, team_id, travel_km FROM load", "travel_km")
def w7_travel(L: League) -> DataFrame:
    return schedule_load(by_team(team_games(L.prepared()), tasks_of(L.games()))).select("game_id", "team_id", "travel_km")


@query(
    "team_form",
    f"SELECT game_id, team_id, is_home, {', '.join(PER_TEAM)} FROM team_features",
    " ".join(PER_TEAM),
)
def team_form(L: League) -> DataFrame:
    narrow = L.prepared().drop("ok", "pool", "season_type", "provider_id", "tip_time_utc", "is_neutral", "is_playoffs")
    return team_features(narrow, L.stats(), tasks_of(L.games())).select("game_id", "team_id", "is_home", *PER_TEAM)


@query(
    "j5_assemble",
    "SELECT game_id, home_elo_pre, away_elo_pre, " + ", ".join(f"diff_{f}" for f in DIFF_FEATURES) + " FROM features",
    "home_elo_pre away_elo_pre " + " ".join(f"diff_{f}" for f in DIFF_FEATURES),
)
def j5_assemble(L: League) -> DataFrame:
    return L.features().select("game_id", "home_elo_pre", "away_elo_pre", *[f"diff_{f}" for f in DIFF_FEATURES])


@query(
    "w13_game_features",
    "SELECT game_id, season, game_date, status, home_win, " + ", ".join(MODEL_FEATURES) + " FROM features",
    "home_win " + " ".join(MODEL_FEATURES),
)
def w13_game_features(L: League) -> DataFrame:
    built = build_features(L.games(), L.stats(), L.arenas(), L.relocations(), SHARED_SITE)
    return built.select("game_id", "season", "game_date", "status", "home_win", *MODEL_FEATURES)


# ---------------------------------------------------------------- ratings

_ELO = "home_elo_pre away_elo_pre home_elo_post away_elo_post"


@query("r1_elo", f"SELECT game_id, {', '.join(_ELO.split())} FROM elo", _ELO)
def r1_elo(L: League) -> DataFrame:
    return rate.rate_games(L.prepared())


@query("r1_elo_incremental", f"SELECT game_id, {', '.join(_ELO.split())} FROM elo JOIN games USING (game_id) WHERE game_date >= DATE '2000-11-01'", _ELO)
def r1_elo_incremental(L: League) -> DataFrame:
    """Resume from the ratings stored before a date and fold only the games after it."""
    cut = F.col("game_date") >= F.lit("2000-11-01").cast("date")
    stored = L.ratings().where(~cut & F.col("elo_post").isNotNull())
    start = stored.groupBy("team_id").agg(
        F.max_by("elo_post", "game_date").alias("rating"), F.max_by("season", "game_date").alias("season")
    )
    return rate.rate_games(L.prepared().where(cut), start)


@query(
    "r2_elo_baseline",
    "SELECT game_id, 1/(1+pow(10.0::DOUBLE, -(home_elo_pre + CASE WHEN is_neutral = 1 THEN 0 ELSE 100 END - away_elo_pre)/400)) AS p FROM features WHERE status = 'final'",
    "p",
)
def r2_elo_baseline(L: League) -> DataFrame:
    rows = L.features().where("status = 'final'")
    p = elo.home_win_probability(F.col("home_elo_pre"), F.col("away_elo_pre"), F.col("is_neutral") == 1)
    return rows.select("game_id", p.alias("p"))


@query("u5_rating_rows", "SELECT game_id, team_id, season, game_date, elo_pre, elo_post FROM ratings", "elo_pre elo_post")
def u5_rating_rows(L: League) -> DataFrame:
    return L.ratings().select("game_id", "team_id", "season", "game_date", "elo_pre", "elo_post")


@query(
    "j11_current_rating",
    """SELECT team_id, coalesce(n.elo_pre, l.elo_post) AS elo FROM
       (SELECT team_id, elo_post FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC) AS rn FROM ratings WHERE elo_post IS NOT NULL) WHERE rn = 1) l
       FULL JOIN (SELECT team_id, elo_pre FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY game_date) AS rn FROM ratings WHERE elo_post IS NULL) WHERE rn = 1) n USING (team_id)""",
    "elo",
)
def j11_current_rating(L: League) -> DataFrame:
    return rate.current_ratings(L.ratings())


@query(
    "w12_season_breaks",
    """SELECT team_id, season, game_date AS day, elo_post AS elo, false AS is_break FROM hist
       UNION ALL SELECT team_id, season, pd + 1, NULL, true FROM hist WHERE ps <> season""".replace(
        "FROM hist",
        """FROM (SELECT *, lag(season) OVER w AS ps, lag(game_date) OVER w AS pd FROM
           (SELECT *, max(season) OVER (PARTITION BY team_id) AS ms FROM ratings WHERE elo_post IS NOT NULL) WHERE season > ms - 3
           WINDOW w AS (PARTITION BY team_id ORDER BY game_date))""",
    ),
    "elo",
)
def w12_season_breaks(L: League) -> DataFrame:
    return serving.with_season_breaks(serving.rating_history(L.ratings()))


@query(
    "a17_last_seasons",
    """SELECT r.team_id, r.game_id, r.season, r.elo_post AS elo FROM ratings r JOIN (SELECT team_id, max(season) AS ms FROM ratings WHERE elo_post IS NOT NULL GROUP BY 1) m
       ON m.team_id = r.team_id WHERE r.elo_post IS NOT NULL AND r.season > m.ms - 3""",
    "elo",
)
def a17_last_seasons(L: League) -> DataFrame:
    return serving.rating_history(L.ratings()).select("team_id", "game_id", "season", "elo")


# ---------------------------------------------------------------- events and states

_STATE = "game_id, action_id, period, clock_seconds, score_home, score_away, possession, seconds_remaining, elapsed_seconds"
_SECONDS = "clock_seconds seconds_remaining elapsed_seconds"


@query("w8_possession", f"SELECT {_STATE} FROM states", _SECONDS)
def w8_possession(L: League) -> DataFrame:
    return L.states().select(*_STATE.split(", "))


@query("w9_forward_fill", "SELECT game_id, action_id, score_home, score_away FROM pbp")
def w9_forward_fill(L: League) -> DataFrame:
    """The feed shows scores only on scoring rows; fill them back in."""
    scoring = F.col("points") > 0
    feed = L.events().select(
        "game_id",
        "action_id",
        F.when(scoring & F.col("location").isNotNull(), F.col("score_home").cast("string")).otherwise("").alias("raw_score_home"),
        F.when(scoring & F.col("location").isNotNull(), F.col("score_away").cast("string")).otherwise("").alias("raw_score_away"),
    )
    return forward_fill_scores(feed, "action_id").select("game_id", "action_id", "score_home", "score_away")


@query(
    "u3_tip_off",
    f"""SELECT {_STATE} FROM states UNION ALL SELECT DISTINCT game_id, 0, 1, 720.0, 0, 0, 0, 2880.0, 0.0 FROM states""",
    _SECONDS,
)
def u3_tip_off(L: League) -> DataFrame:
    return states_with_tip_off(L.events()).select(*_STATE.split(", "))


@query(
    "m9_training_states",
    """SELECT s.game_id, action_id, season, possession, seconds_remaining, CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS home_win, (ok % 97 + 1)/98.0::DOUBLE AS pregame_prob
       FROM (SELECT game_id, action_id, possession, seconds_remaining FROM states UNION ALL SELECT DISTINCT game_id, 0, 0, 2880.0 FROM states) s
       JOIN games g ON g.game_id = s.game_id WHERE status = 'final' AND ok % 4 <> 0""",
    "seconds_remaining pregame_prob",
)
def m9_training_states(L: League) -> DataFrame:
    pregame = L.games().where("ok % 4 <> 0").select("game_id", ((F.col("ok") % 97 + 1) / 98.0).alias("pregame_prob"))
    rows = training_states(L.events(), L.games(), pregame)
    return rows.select("game_id", "action_id", "season", "possession", "seconds_remaining", "home_win", "pregame_prob")


@query(
    "u4_states_by_season",
    "SELECT season, count(*) AS states, count(DISTINCT game_id) AS games FROM states JOIN games USING (game_id) WHERE status = 'final' GROUP BY 1",
)
def u4_states_by_season(L: League) -> DataFrame:
    rows = L.states().join(L.games().where("status = 'final'").select("game_id", "season"), "game_id")
    per_game = rows.groupBy("season", "game_id").agg(F.count(F.lit(1)).alias("n"))
    return per_game.groupBy("season").agg(F.sum("n").alias("states"), F.count(F.lit(1)).alias("games"))


# ---------------------------------------------------------------- retention


@query(
    "w10_thinning",
    """SELECT id FROM (SELECT s.id, row_number() OVER (PARTITION BY game_id, source ORDER BY action_id, s.id) - 1 AS i, count(*) OVER (PARTITION BY game_id, source) AS n, status
         FROM snaps s JOIN games USING (game_id))
       WHERE status <> 'final' OR n <= 20 OR i = n - 1 OR floor(i * 19.0::DOUBLE / (n - 1)) <> floor((i - 1) * 19.0::DOUBLE / (n - 1))""",
)
def w10_thinning(L: League) -> DataFrame:
    return thin(L.snapshots(), L.games(), 20).select("id")


@query("j16_drop_old", "SELECT id FROM predictions WHERE game_id NOT IN (SELECT game_id FROM games WHERE season < 2000 - 3 + 1)")
def j16_drop_old(L: League) -> DataFrame:
    return drop_old(L.predictions(), L.games(), 2000, 3).select("id")


@query(
    "running_points",
    """SELECT user_id, event_id, CAST(row_number() OVER w AS BIGINT) AS n, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS clicks
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def running_points(L: League) -> DataFrame:
    """The running sum itself over every user's whole event history, cut into even stretches."""
    events = L.table("events").select("user_id", "event_id", "ts", "event_type")
    cut = cut_by_range(events, ["user_id"], ["ts", "event_id"], f"{L._tag()}/running_points")
    sums = {"n": F.lit(1).cast("long"), "clicks": (F.col("event_type") == "click").cast("long")}
    rows = running(cut, ["user_id"], F.col("chunk"), ["ts", "event_id"], sums=sums)
    return rows.select("user_id", "event_id", "n", "clicks")
