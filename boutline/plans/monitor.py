"""How models do on finished games against how they were expected to do."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.operators.evaluation import bin_sums, summary_of_bins
from boutline.operators.latest import latest_by

# Thresholds per model kind.
MIN_GAMES = {"pregame": 50, "ingame": 20}
TOLERANCE = {"pregame": 0.03, "ingame": 0.05}
MAX_ECE = 0.06
ECE_MIN_GAMES = 200


def finished(games: DataFrame, season: int) -> DataFrame:
    return games.where((F.col("status") == "final") & (F.col("season") == season)).select(
        "game_id", "game_date", (F.col("home_score") > F.col("away_score")).cast("int").alias("home_win")
    )


def pregame_rows(predictions: DataFrame, games: DataFrame, season: int) -> DataFrame:
    """Each finished game's latest prediction among those made before tip-off."""
    forecasts = predictions.where("made_before_tip").select(
        "game_id", "created_at", "id", "model_version", "home_win_prob"
    )
    mine = forecasts.join(finished(games, season).select("game_id"), "game_id", "left_semi")
    latest = latest_by(mine, ["game_id"], ["created_at", "id"]).drop("created_at", "id")
    return latest.join(finished(games, season), "game_id").withColumn("model", F.lit("pregame"))


def ingame_rows(snapshots: DataFrame, games: DataFrame, season: int) -> DataFrame:
    """Every live point of finished games; replays are excluded."""
    live = snapshots.where("source = 'live'").select("game_id", "model_version", "home_win_prob")
    return live.join(finished(games, season), "game_id").withColumn("model", F.lit("ingame"))


def windows_of(today: date, season: int) -> dict[str, date]:
    return {"season": date(season, 8, 1), "last_30_days": today - timedelta(days=30)}


def in_windows(rows: DataFrame, windows: dict[str, date]) -> DataFrame:
    """Each row once per window it falls into (two windows: no join needed)."""
    names = F.filter(
        F.array(*[F.when(F.col("game_date") >= F.lit(since), F.lit(name)) for name, since in windows.items()]),
        lambda n: n.isNotNull(),
    )
    return rows.withColumn("window", F.explode(names))


def _by_kind(values: dict[str, float]) -> F.Column:
    return F.when(F.col("model") == "pregame", values["pregame"]).otherwise(values["ingame"])


def judge(
    rows: DataFrame,
    expected: DataFrame,
    kinds: DataFrame,
    min_games: dict[str, int] | None = None,
) -> DataFrame:
    """One verdict per (model, window) of `kinds`. `rows`: model, window, game_id, model_version,
    home_win_prob, home_win. `expected`: model, model_version, logloss."""
    keys = ["model", "window"]
    # Reduced to games first, so no window's rows meet in one task.
    games = rows.groupBy(*keys, "game_id").agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.sum("one").alias("games"))
    metrics = summary_of_bins(bin_sums(rows, keys, "home_win", "home_win_prob"), keys)
    counted = rows.groupBy(*keys, "model_version").agg(F.count(F.lit(1)).alias("cnt"))
    # Most frequent version; ties go to the smallest string.
    version = counted.groupBy(*keys).agg(F.min_by("model_version", F.struct(-F.col("cnt"), "model_version")).alias("version"))
    joined = (
        kinds.join(games, keys, "left")
        .join(metrics, keys, "left")
        .join(version, keys, "left")
        .join(
            expected.select("model", F.col("model_version").alias("version"), F.col("logloss").alias("expected")),
            ["model", "version"],
            "left",
        )
        .withColumn("games", F.coalesce("games", F.lit(0)))
        .withColumn("needed", _by_kind({**MIN_GAMES, **(min_games or {})}).cast("long"))
    )
    enough = F.col("games") >= F.col("needed")
    worse = F.coalesce(F.col("logloss") > F.col("expected") + _by_kind(TOLERANCE), F.lit(False))
    miscalibrated = (F.col("games") >= ECE_MIN_GAMES) & (F.col("ece") > MAX_ECE)
    base = F.format_string("Log loss %.3f over %d games", "logloss", "games")
    against = F.when(
        F.col("expected").isNotNull(), F.concat(base, F.format_string(", expected about %.3f.", "expected"))
    ).otherwise(F.concat(base, F.lit("; no held-out log loss to compare with.")))
    message = F.when(worse, F.concat(F.lit("Worse than expected: "), against)).otherwise(against)
    message = F.when(
        miscalibrated,
        F.concat(
            message, F.format_string(f" Calibration error %.1f%% is above {MAX_ECE:.0%}.".replace("6%.", "6%%."), F.col("ece") * 100)
        ),
    ).otherwise(message)
    few = F.format_string("%d finished games with predictions; at least %d are needed.", "games", "needed")
    return joined.select(
        "model",
        "window",
        F.when(enough, F.col("version")).alias("model_version"),
        "games",
        *[F.when(enough, F.col(m)).alias(m) for m in ("logloss", "brier", "accuracy", "ece")],
        F.when(enough, F.col("expected")).alias("expected_logloss"),
        F.when(~enough, "insufficient").when(worse | miscalibrated, "warning").otherwise("ok").alias("status"),
        F.when(enough, message).otherwise(few).alias("message"),
    )


def run_monitor(
    predictions: DataFrame,
    snapshots: DataFrame,
    games: DataFrame,
    expected: DataFrame,
    today: date,
    min_games: dict[str, int] | None = None,
) -> DataFrame:
    """Both models over the season and the last 30 days, as one plan."""
    season = today.year if today.month >= 8 else today.year - 1
    windows = windows_of(today, season)
    shared = ["model", "game_id", "game_date", "model_version", "home_win_prob", "home_win"]
    rows = pregame_rows(predictions, games, season).select(*shared).unionByName(
        ingame_rows(snapshots, games, season).select(*shared)
    )
    kinds = games.sparkSession.createDataFrame([(m, w) for m in MIN_GAMES for w in windows], "model string, window string")
    return judge(in_windows(rows, windows), expected, kinds, min_games)
