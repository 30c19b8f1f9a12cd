"""Read queries over the stored tables: slate, detail, teams, model, status, series
(T2-T7, J6, J7, J11, J17, A12, A14, A17, W12, P30, P31, P33, P34)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.functions import display
from boutline.operators.latest import attach_latest, latest_by
from boutline.operators.ratings import current_ratings
from boutline.operators.running import row_numbers

SHOWN_FACTORS = 5
RECENT_GAMES = 10
UPCOMING_GAMES = 5
HISTORY_SEASONS = 3
TOP_FEATURES = 12

# Fixed values: (feature, label, higher is better) of the side-by-side comparison.
COMPARISON = [
    ("elo_pre", "Elo rating", True),
    ("win_pct", "Win %", True),
    ("std_net", "Net rating", True),
    ("std_ortg", "Offensive rating", True),
    ("std_drtg", "Defensive rating", False),
    ("l10_net", "Net rating, last 10", True),
    ("std_pace", "Pace", True),
    ("prev_net", "Last season's net rating", True),
    ("rest_days", "Days of rest", True),
    ("travel_km", "Travel since last game (km)", False),
]


def with_teams(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Add the abbreviations of both sides (`home`, `away`)."""
    for side in ("home", "away"):
        names = teams.select(F.col("team_id").alias(f"{side}_team_id"), F.col("abbreviation").alias(side))
        games = games.join(names, f"{side}_team_id", "left")
    return games


# ---------------------------------------------------------------- games


def summaries(games: DataFrame, predictions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Games with their latest prediction and, while live, their latest live point. Both
    histories are cut to the games asked for before they are reduced."""
    ids = games.select("game_id")
    predictions = predictions.join(ids, "game_id", "left_semi")
    live = snapshots.where("source = 'live'").join(
        games.where("status = 'live'").select("game_id"), "game_id", "left_semi"
    )
    out = attach_latest(
        games,
        predictions,
        ["game_id"],
        ["created_at", "id"],
        ["home_win_prob", "model_version", "created_at", "made_before_tip", "factors"],
    )
    renamed = live.select(
        "game_id",
        "action_id",
        "id",
        F.col("home_win_prob").alias("live_prob"),
        F.col("period").alias("live_period"),
        F.col("clock_seconds").alias("live_clock"),
        F.col("score_home").alias("live_home"),
        F.col("score_away").alias("live_away"),
    )
    return attach_latest(
        out,
        renamed,
        ["game_id"],
        ["action_id", "id"],
        ["live_prob", "live_period", "live_clock", "live_home", "live_away"],
    )


def slate(games: DataFrame, predictions: DataFrame, snapshots: DataFrame, teams: DataFrame, day: date) -> DataFrame:
    """One date's games in tip-off order; games without a tip time come last."""
    today = games.where(F.col("game_date") == F.lit(day))
    rows = with_teams(summaries(today, predictions, snapshots), teams)
    return rows.orderBy(F.asc_nulls_last("tip_time_utc"), "game_id")


def adjacent_dates(games: DataFrame, day: date) -> DataFrame:
    d = F.col("game_date")
    return games.agg(
        F.max(F.when(d < F.lit(day), d)).alias("prev_date"), F.min(F.when(d > F.lit(day), d)).alias("next_date")
    )


def all_adjacent_dates(games: DataFrame) -> DataFrame:
    """Previous and next date with games for every date; one row per date, so calendar-bounded."""
    order = Window.orderBy("game_date")
    days = games.select("game_date").distinct()
    return days.select(
        "game_date", F.lag("game_date").over(order).alias("prev_date"), F.lead("game_date").over(order).alias("next_date")
    )


def comparison(features: DataFrame) -> DataFrame:
    """Wide features to ten rows per game, with the side that is better."""
    items = F.array(
        *[
            F.struct(
                F.lit(key).alias("key"),
                F.lit(label).alias("label"),
                F.col(f"home_{key}").alias("home"),
                F.col(f"away_{key}").alias("away"),
                F.lit(higher).alias("higher_is_better"),
            )
            for key, label, higher in COMPARISON
        ]
    )
    rows = features.select("game_id", F.explode(items).alias("c")).select("game_id", "c.*")
    home_better = (F.col("home") > F.col("away")) == F.col("higher_is_better")
    return rows.withColumn(
        "better", F.when(F.col("home") != F.col("away"), F.when(home_better, "home").otherwise("away"))
    )


def shown_factors(factors: str = "factors", home: str = "home", away: str = "away") -> Column:
    """The first five factors with a value, labelled; a positive contribution favours home."""
    known = F.filter(F.col(factors), lambda f: f["value"].isNotNull())
    labelled = F.transform(
        known,
        lambda f: F.struct(
            f["feature"].alias("feature"),
            display.feature_label(f["feature"], F.col(home), F.col(away)).alias("label"),
            f["value"].alias("value"),
            f["contribution"].alias("contribution"),
            F.when(f["contribution"] > 0, "home").otherwise("away").alias("favors"),
        ),
    )
    return F.slice(labelled, 1, SHOWN_FACTORS)


def game_details(
    games: DataFrame, predictions: DataFrame, snapshots: DataFrame, teams: DataFrame, features: DataFrame
) -> DataFrame:
    """Slate row, factors and comparison of each game in `games`."""
    rows = with_teams(summaries(games, predictions, snapshots), teams).withColumn("factors", shown_factors())
    compared = comparison(features.join(games.select("game_id"), "game_id", "left_semi"))
    packed = compared.groupBy("game_id").agg(
        F.collect_list(F.struct("key", "label", "home", "away", "higher_is_better", "better")).alias("comparison")
    )
    return rows.join(packed, "game_id", "left")


# ---------------------------------------------------------------- teams


def team_views(games: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every game from both teams' side with that side's win probability."""
    rows = attach_latest(games, predictions, ["game_id"], ["created_at", "id"], ["home_win_prob"])
    sides = F.array(
        *[
            F.struct(
                F.col(f"{own}_team_id").alias("team_id"),
                F.col(f"{other}_team_id").alias("opp_id"),
                F.lit(own == "home").alias("is_home"),
                F.col(f"{own}_score").alias("score"),
                F.col(f"{other}_score").alias("opp_score"),
                (F.col("home_win_prob") if own == "home" else 1 - F.col("home_win_prob")).alias("win_prob"),
            )
            for own, other in (("home", "away"), ("away", "home"))
        ]
    )
    return rows.select("game_id", "game_date", "status", F.explode(sides).alias("t")).select(
        "game_id", "game_date", "status", "t.*"
    )


def recent_and_upcoming(views: DataFrame, recent: int = RECENT_GAMES, upcoming: int = UPCOMING_GAMES) -> DataFrame:
    """Last finished and next unfinished games of every team (`kind`, `rank`). The rank filter
    reaches below the shuffle, so each task sends at most n rows per team."""
    last = Window.partitionBy("team_id").orderBy(F.desc("game_date"), F.desc("game_id"))
    following = Window.partitionBy("team_id").orderBy("game_date", "game_id")
    done = views.where("status = 'final'").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= recent)
    todo = (
        views.where("status <> 'final'").withColumn("rank", F.row_number().over(following)).where(F.col("rank") <= upcoming)
    )
    return done.withColumn("kind", F.lit("recent")).unionByName(todo.withColumn("kind", F.lit("upcoming")))


def team_ranking(teams: DataFrame, ratings: DataFrame) -> DataFrame:
    """Teams by current rating, best first; unrated teams count as 0. Ranks are assembled per
    rating band, so no task orders all teams."""
    rated = teams.join(current_ratings(ratings), "team_id", "left")
    keyed = rated.withColumn("__key", -F.coalesce("elo", F.lit(0.0)))
    return row_numbers(keyed, [], F.floor(F.col("__key")), ["__key", "team_id"], name="rank").drop("__key")


def rating_history(ratings: DataFrame, seasons: int = HISTORY_SEASONS) -> DataFrame:
    """Post-game ratings of each team's last seasons (a team's rows are calendar-bounded)."""
    newest = F.max("season").over(Window.partitionBy("team_id"))
    rated = ratings.where("elo_post IS NOT NULL").withColumn("__newest", newest)
    return rated.where(F.col("season") > F.col("__newest") - seasons).select(
        "team_id", "game_id", "game_date", "season", F.col("elo_post").alias("elo")
    )


def with_season_breaks(history: DataFrame) -> DataFrame:
    """Insert an empty point a day after each season's last game, so a line chart breaks there."""
    order = Window.partitionBy("team_id").orderBy("game_date", "game_id")
    rows = history.select(
        "*", F.lag("season").over(order).alias("__season"), F.lag("game_date").over(order).alias("__date")
    )
    point = F.struct(F.col("game_date").alias("day"), F.col("elo").alias("elo"), F.lit(False).alias("is_break"))
    gap = F.struct(
        F.date_add("__date", 1).alias("day"), F.lit(None).cast("double").alias("elo"), F.lit(True).alias("is_break")
    )
    points = F.when(F.col("__season") != F.col("season"), F.array(gap, point)).otherwise(F.array(point))
    return rows.select("team_id", "season", F.explode(points).alias("p")).select("team_id", "season", "p.*")


# ---------------------------------------------------------------- model and operations


def importance_shares(importance: DataFrame, top: int = TOP_FEATURES) -> DataFrame:
    """Share of total gain per feature of each model version, largest first."""
    gains = importance.select("version", F.explode("importance").alias("feature", "gain"))
    # A version has one row per model feature: bounded by the model's width.
    every = Window.partitionBy("version")
    ranked = every.orderBy(F.desc("gain"), "feature")
    total = F.sum("gain").over(every)
    shares = gains.select(
        "version",
        "feature",
        F.when(total != 0, F.try_divide(F.col("gain"), total)).otherwise(F.col("gain")).alias("share"),
        F.row_number().over(ranked).alias("rank"),
    )
    return shares.where(F.col("rank") <= top)


def model_in_use(versions: DataFrame) -> DataFrame:
    return versions.orderBy(F.desc("first_used_at")).limit(1)


def latest_monitoring(runs: DataFrame) -> DataFrame:
    """Latest check per (model, window): pre-game first, season before 30 days."""
    return latest_by(runs, ["model", "window"], ["run_at", "id"]).orderBy(F.desc("model"), F.desc("window"))


def latest_jobs(runs: DataFrame) -> DataFrame:
    return latest_by(runs, ["job"], ["started_at", "id"]).orderBy("job")


def models_in_use(versions: DataFrame, snapshots: DataFrame) -> DataFrame:
    pregame = versions.agg(F.max_by("version", "first_used_at").alias("pregame"))
    ingame = snapshots.agg(F.max_by("model_version", "id").alias("ingame"))
    both = pregame.unionByName(ingame, allowMissingColumns=True)
    return both.agg(F.max("pregame").alias("pregame"), F.max("ingame").alias("ingame"))


# ---------------------------------------------------------------- live series


def preferred_series(snapshots: DataFrame) -> DataFrame:
    """Live points of a game if it has any, else its replay."""
    has_live = snapshots.groupBy("game_id").agg(F.bool_or(F.col("source") == "live").alias("__live"))
    wanted = F.when(F.col("__live"), "live").otherwise("replay")
    return snapshots.join(has_live, "game_id").where(F.col("source") == wanted).drop("__live")


def chart_rows(snapshots: DataFrame) -> DataFrame:
    """First and last point of each series and the ends of periods."""
    series, place = ["game_id", "source"], F.struct("action_id", "id")
    ends = snapshots.groupBy(*series).agg(F.min(place).alias("__first"), F.max(place).alias("__last"))
    joined = snapshots.join(ends, series)
    shown = (place == F.col("__first")) | (place == F.col("__last")) | (F.col("clock_seconds") == 0)
    return joined.where(shown).select(*snapshots.columns)
