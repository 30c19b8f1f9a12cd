"""Point-in-time game features, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.operators.form import (
    STATE,
    attach_state,
    by_team,
    post_game_state,
    previous_season,
    schedule_load,
)
from boutline.operators.ratings import rate_games
from boutline.operators.teamgames import SharedSite, prepare_games, team_games_with_box
from boutline.session import dealt, tasks_for

FEATURE_VERSION = "v1"
TASK_GAMES = 100_000  # of a task: sorted team rows with their windows take about 2.3 KB a game
SCHEDULE = ["rest_days", "b2b", "games_last7", "travel_km"]
TEAM_FEATURES = ["elo_pre", *STATE, "prev_net", *SCHEDULE]
DIFF_FEATURES = [
    "elo_pre", "win_pct", "std_net", "l10_net", "l5_net", "prev_net", "rest_days",
    "std_efg", "std_opp_efg", "travel_km",
]
GAME_FEATURES = ["is_neutral", "is_playoffs"]
MODEL_FEATURES = (
    [f"home_{f}" for f in TEAM_FEATURES]
    + [f"away_{f}" for f in TEAM_FEATURES]
    + [f"diff_{f}" for f in DIFF_FEATURES]
    + GAME_FEATURES
)
GAME_COLUMNS = [
    "game_id", "season", "season_type", "game_date", "status", "home_team_id", "away_team_id",
    "home_score", "away_score",
]


def tasks_of(games: DataFrame) -> int | None:
    """How many tasks form over `games` needs, a stored table that is counted by its files' footers."""
    return tasks_for(games.sparkSession, games.count(), TASK_GAMES)


def team_features(games: DataFrame, stats: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per (game, team): form before the game and schedule load. Three shuffles: games
    and box scores by game, team rows by team (shared by every window); over `tasks` if given."""
    rows = by_team(team_games_with_box(games, stats, tasks), tasks)
    return attach_state(schedule_load(previous_season(post_game_state(rows))))


def build_features(
    games: DataFrame,
    stats: DataFrame,
    arenas: DataFrame,
    relocations: DataFrame,
    shared: SharedSite | None = None,
    rated: DataFrame | None = None,
) -> DataFrame:
    """Model features per game, final or scheduled; nothing from the game's own date or later
    enters. `rated` takes ratings computed elsewhere (incrementally, or read back)."""
    prepared = prepare_games(games, arenas, relocations, shared)
    tasks = tasks_of(games)
    wide = wide_form(prepared, stats, tasks)
    return join_features(prepared, rate_games(prepared) if rated is None else rated, wide, tasks)


def wide_form(prepared: DataFrame, stats: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per prepared game: form and schedule load of both sides."""
    per_team = [f for f in TEAM_FEATURES if f != "elo_pre"]
    narrow = prepared.select(
        "game_id", "season", "game_date", "status", "site_lat", "site_lon",
        "home_team_id", "away_team_id", "home_score", "away_score",
    )
    sides = team_features(narrow, stats, tasks).select("game_id", "is_home", *per_team)
    return dealt(sides, tasks, "game_id").groupBy("game_id").agg(
        *[
            F.expr(f"max(CASE WHEN is_home = {home} THEN {f} END) AS {side}_{f}")
            for side, home in (("home", "true"), ("away", "false"))
            for f in per_team
        ]
    )


def join_features(prepared: DataFrame, rated: DataFrame, wide: DataFrame, tasks: int | None = None) -> DataFrame:
    """Feature rows of prepared games from their ratings and form."""
    games = prepared.select(*GAME_COLUMNS, *[F.col(f).cast("double").alias(f) for f in GAME_FEATURES])
    out = (
        dealt(games, tasks, "game_id")
        .join(dealt(rated, tasks, "game_id"), "game_id")
        .join(wide, "game_id", "left")
    )
    return out.selectExpr(
        *GAME_COLUMNS,
        *MODEL_FEATURES[: 2 * len(TEAM_FEATURES)],
        *[f"home_{f} - away_{f} AS diff_{f}" for f in DIFF_FEATURES],
        *GAME_FEATURES,
        "home_elo_post",
        "away_elo_post",
        "CASE WHEN status = 'final' THEN CAST(home_score > away_score AS DOUBLE) END AS home_win",
    )


def labelled(features: DataFrame, first_season: int) -> DataFrame:
    """Final games usable for training and evaluation."""
    return features.where((F.col("status") == "final") & (F.col("season") >= first_season))


def features_as_json(features: DataFrame, version: str = FEATURE_VERSION, keep: tuple[str, ...] = ()) -> DataFrame:
    """Feature columns as one JSON document per game, beside columns to `keep`; NULLs stay as JSON nulls."""
    document = F.to_json(F.struct(*MODEL_FEATURES), {"ignoreNullFields": "false"})
    return features.select("game_id", F.lit(version).alias("feature_version"), document.alias("features"), *keep)


def features_from_json(documents: DataFrame) -> DataFrame:
    schema = ", ".join(f"{f} double" for f in MODEL_FEATURES)
    parsed = documents.withColumn("__f", F.from_json("features", schema))
    return parsed.select(*[c for c in documents.columns if c != "features"], "__f.*")
