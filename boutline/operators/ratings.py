"""Pairwise rating fold.

A rating depends on every earlier opponent, so one pool of entities that play each other is
folded in (date, game) order. Pools are independent, and `games` must name each game's `pool`.
Two forms give the same rows, and the caller chooses: `stream_pools` (what `rate_games` uses)
streams each pool's sorted rows through a small fold, pools side by side; `rate_in_rounds` is for
a pool too long for one task: games in which no team plays twice are independent of each other, so
a date is one distributed join against the current ratings, or several if a team plays twice.

A final game without both scores, or of a team against itself, cannot be rated: like an unplayed
one it gets the ratings before it and none after it, and `unrated` lists it."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from boutline.functions import elo
from boutline.functions.elo import HOME_ADVANTAGE, INITIAL, SEASON_CARRYOVER, SEASON_MEAN, K
from boutline.session import fresh_path, materialise, shared_dir

SIDES = ("home", "away")
RATED = "game_id string, home_elo_pre double, away_elo_pre double, home_elo_post double, away_elo_post double"
RATABLE = "status = 'final' AND home_score IS NOT NULL AND away_score IS NOT NULL AND home_team_id <> away_team_id"


FOLDED = [
    "pool", "game_id", "season", "home_team_id", "away_team_id", "ratable", "is_neutral", "margin",
    "home_start", "home_start_season", "away_start", "away_start_season",
]


def _fold_pools(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold rows sorted by (pool, date, game); state is one rating and season per team."""
    pool, ratings = None, {}
    for batch in batches:
        pre, post = ([], []), ([], [])
        for row_pool, season, home_id, away_id, ratable, is_neutral, margin, *starts in zip(
            *[batch[c].tolist() for c in FOLDED if c != "game_id"]
        ):
            if row_pool != pool:
                pool, ratings = row_pool, {}
            for out, team, start, start_season in ((pre[0], home_id, *starts[:2]), (pre[1], away_id, *starts[2:])):
                known = ratings.get(team)
                if known is not None:
                    value, value_season = known
                elif start is not None and start == start:
                    value, value_season = start, start_season
                else:
                    value, value_season = INITIAL, season
                if value_season != season:
                    value = SEASON_CARRYOVER * value + (1 - SEASON_CARRYOVER) * SEASON_MEAN
                out.append(value)
            if not ratable:
                post[0].append(None)
                post[1].append(None)
                continue
            home, away = pre[0][-1], pre[1][-1]
            diff = home - away + (0.0 if is_neutral else HOME_ADVANTAGE)
            won = margin > 0
            expected = 1.0 / (1.0 + 10.0 ** (-diff / 400.0))
            damping = 7.5 + 0.006 * (diff if won else -diff)
            shift = K * (abs(margin) + 3.0) ** 0.8 / damping * (won - expected)
            ratings[home_id] = (home + shift, season)
            ratings[away_id] = (away - shift, season)
            post[0].append(home + shift)
            post[1].append(away - shift)
        names = [f.split()[0] for f in RATED.split(", ")]
        yield pd.DataFrame(dict(zip(names, (batch["game_id"], *(np.array(v, float) for v in (*pre, *post))))))


def _with_start(games: DataFrame, start: DataFrame | None) -> DataFrame:
    if start is None:
        empty = F.lit(None).cast("double"), F.lit(None).cast("int")
        return games.select(
            "*",
            *[e.alias(f"{s}_{n}") for s in ("home", "away") for e, n in zip(empty, ("start", "start_season"))],
        )
    for side in ("home", "away"):
        games = games.join(
            start.select(
                F.col("team_id").alias(f"{side}_team_id"),
                F.col("rating").alias(f"{side}_start"),
                F.col("season").cast("int").alias(f"{side}_start_season"),
            ),
            f"{side}_team_id",
            "left",
        )
    return games


def stream_pools(games: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Rate all pools side by side; each pool's rows pass once, in order, through one task."""
    rows = _with_start(games, start).select(
        F.col("pool").cast("string").alias("pool"),
        "game_date",
        "game_id",
        F.col("season").cast("int").alias("season"),
        F.col("home_team_id").cast("string").alias("home_team_id"),
        F.col("away_team_id").cast("string").alias("away_team_id"),
        F.expr(RATABLE).alias("ratable"),
        F.coalesce("is_neutral", F.lit(False)).alias("is_neutral"),
        F.coalesce((F.col("home_score") - F.col("away_score")).cast("double"), F.lit(0.0)).alias("margin"),
        "home_start",
        F.coalesce("home_start_season", F.lit(0)).alias("home_start_season"),
        "away_start",
        F.coalesce("away_start_season", F.lit(0)).alias("away_start_season"),
    )
    ordered = rows.repartition("pool").sortWithinPartitions("pool", "game_date", "game_id")
    return ordered.select(*FOLDED).mapInPandas(_fold_pools, RATED)  # a date costs Python more than the fold


def rate_in_rounds(
    games: DataFrame, start: DataFrame | None = None, name: str = "rounds", checkpoint_every: int = 10
) -> DataFrame:
    """Rate by distributed rounds in which a team plays once: one per date, or, on dates on which
    some team plays more often, as many as it takes. Each round's games are written to the shared
    folder, the ratings table is checkpointed every few rounds."""
    spark = games.sparkSession
    shared_dir(spark)
    path = fresh_path(spark, name)
    # One value per calendar date: bounded by the calendar, not by the number of games.
    team_days = games.select("game_date", F.explode(F.array(*[F.col(f"{s}_team_id").cast("string") for s in SIDES])).alias("t"))
    per_team = team_days.groupBy("game_date", "t").agg(F.count(F.lit(1)).alias("n"))
    days = per_team.groupBy("game_date").agg(F.max("n").alias("most")).orderBy("game_date").collect()
    empty = spark.createDataFrame([], "team_id string, rating double, season int")
    ratings = empty if start is None else start.select(
        F.col("team_id").cast("string").alias("team_id"), "rating", F.col("season").cast("int").alias("season")
    )
    for i, today in enumerate(_rounds(games, days, name)):
        for side in SIDES:
            today = today.join(
                ratings.select(
                    F.col("team_id").alias(f"__{side}"),
                    F.col("rating").alias(f"__{side}_r"),
                    F.col("season").alias(f"__{side}_s"),
                ),
                F.col(f"{side}_team_id").cast("string") == F.col(f"__{side}"),
                "left",
            )

        def pre(side: str) -> F.Column:
            rating, season = F.col(f"__{side}_r"), F.col(f"__{side}_s")
            return (
                F.when(rating.isNull(), F.lit(elo.INITIAL))
                .when(season != F.col("season"), elo.regress_to_mean(rating))
                .otherwise(rating)
            )

        rated = today.withColumn("home_elo_pre", pre("home")).withColumn("away_elo_pre", pre("away"))
        shift = elo.rating_shift(
            F.col("home_elo_pre"),
            F.col("away_elo_pre"),
            F.col("home_score") - F.col("away_score"),
            F.col("is_neutral"),
        )
        rated = rated.withColumn("__shift", F.when(F.expr(RATABLE), shift)).select(
            "game_id",
            "season",
            F.col("home_team_id").cast("string").alias("home"),
            F.col("away_team_id").cast("string").alias("away"),
            "home_elo_pre",
            "away_elo_pre",
            (F.col("home_elo_pre") + F.col("__shift")).alias("home_elo_post"),
            (F.col("away_elo_pre") - F.col("__shift")).alias("away_elo_post"),
        )
        rated.write.mode("overwrite").parquet(f"{path}/round={i}")
        done = spark.read.schema(rated.schema).parquet(f"{path}/round={i}")
        moved = done.where("home_elo_post IS NOT NULL").select(
            F.col("season").cast("int").alias("season"),
            F.explode(
                F.array(
                    F.struct(F.col("home").alias("team_id"), F.col("home_elo_post").alias("rating")),
                    F.struct(F.col("away").alias("team_id"), F.col("away_elo_post").alias("rating")),
                )
            ).alias("t"),
        )
        moved = moved.select("t.team_id", "t.rating", "season")
        ratings = ratings.join(moved, "team_id", "left_anti").unionByName(moved)
        if (i + 1) % checkpoint_every == 0:
            ratings = ratings.checkpoint()
    columns = [f.split()[0] for f in RATED.split(", ")]
    if not days:
        return spark.createDataFrame([], RATED)
    return spark.read.parquet(path).select(*columns)


def _rounds(games: DataFrame, days: list[Row], name: str) -> Iterator[DataFrame]:
    """Games that can be rated at once, in order."""
    for day in days:
        left = games.where(F.col("game_date") == F.lit(day["game_date"]))
        if day["most"] == 1:
            yield left
            continue
        # A team plays several times: first the games that come first for both their teams.
        while not left.isEmpty():
            team = F.explode(F.array(*[F.col(f"{s}_team_id").cast("string") for s in SIDES]))
            first = left.select("game_id", team.alias("t")).groupBy("t").agg(F.min("game_id").alias("game_id"))
            sides = F.when(F.col("home_team_id") == F.col("away_team_id"), 1).otherwise(2)
            both = first.groupBy("game_id").agg(F.count(F.lit(1)).alias("n")).join(left.select("game_id", sides.alias("sides")), "game_id")
            both = both.where("n = sides").select("game_id")
            ready = materialise(left.join(both, "game_id", "left_semi"), f"{name}/ready")
            left = materialise(left.join(both, "game_id", "left_anti"), f"{name}/left")
            yield ready


def rate_games(games: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Pre- and post-game ratings of every game of every `pool`.

    `start` (team_id, rating, season) resumes from stored ratings: pass only the new games."""
    return stream_pools(games, start)


def rating_inputs(games: DataFrame) -> DataFrame:
    """(game_id, game_date, season, digest): what a game's rating depends on, to find out later
    which games have changed."""
    shown = [
        F.coalesce(c.cast("string"), F.lit("<null>"))
        for c in (
            F.col("game_date"), F.col("season"), F.col("home_team_id"), F.col("away_team_id"), F.expr(RATABLE),
            F.coalesce("is_neutral", F.lit(False)), F.col("home_score") - F.col("away_score"),
        )
    ]
    return games.select("game_id", "game_date", "season", F.md5(F.concat_ws("|", *shown)).alias("digest"))


def first_change(now: DataFrame, before: DataFrame) -> date | None:
    """The day of the earliest game that is new, gone or not what it was (both as `rating_inputs`
    gives them); None if none is."""
    old = before.select(F.col("game_id").alias("old_id"), F.col("game_date").alias("old_date"), F.col("digest").alias("old_digest"))
    both = now.join(old, F.col("game_id") == F.col("old_id"), "full_outer")
    changed = both.where(~F.col("digest").eqNullSafe(F.col("old_digest")))
    return changed.agg(F.min(F.least("game_date", "old_date"))).first()[0]


def ratings_before(ratings: DataFrame, day: date) -> DataFrame:
    """(team_id, rating, season): where stored rating rows leave each team before a day."""
    played = ratings.where((F.col("game_date") < F.lit(day)) & F.col("elo_post").isNotNull())
    newest = F.max_by(F.struct(F.col("elo_post").alias("rating"), "season"), F.struct("game_date", "game_id"))
    return played.groupBy("team_id").agg(newest.alias("last")).select("team_id", "last.*")


def rate_since(games: DataFrame, ratings: DataFrame, day: date | None) -> DataFrame:
    """Ratings of all `games` when stored rating rows hold for every game before `day` (None: for
    all): only games from that day on are folded, from the ratings before it."""
    kept = games if day is None else games.where(F.col("game_date") < F.lit(day))
    rows = kept.select("game_id", "home_team_id").join(ratings.select("game_id", "team_id", "elo_pre", "elo_post"), "game_id")
    of = lambda home, c: F.max(F.when((F.col("team_id") == F.col("home_team_id")) == F.lit(home), F.col(c)))
    stored = rows.groupBy("game_id").agg(
        of(True, "elo_pre").alias("home_elo_pre"), of(False, "elo_pre").alias("away_elo_pre"),
        of(True, "elo_post").alias("home_elo_post"), of(False, "elo_post").alias("away_elo_post"),
    )
    if day is None:
        return stored
    later = games.where(F.col("game_date") >= F.lit(day))
    return stored.unionByName(rate_games(later, ratings_before(ratings, day)).select(*stored.columns))


def unrated(games: DataFrame) -> DataFrame:
    """Final games that no rating can use: rejects for whoever loads them."""
    return games.where(f"status = 'final' AND NOT ({RATABLE})")


def rating_rows(games: DataFrame, rated: DataFrame) -> DataFrame:
    """Long form: one (game, team) row with its rating before and after."""
    joined = games.select("game_id", "season", "game_date", "home_team_id", "away_team_id").join(rated, "game_id")
    rows = F.array(
        *[
            F.struct(
                F.col(f"{s}_team_id").alias("team_id"),
                F.col(f"{s}_elo_pre").alias("elo_pre"),
                F.col(f"{s}_elo_post").alias("elo_post"),
            )
            for s in ("home", "away")
        ]
    )
    return joined.select("game_id", "season", "game_date", F.explode(rows).alias("r")).select(
        "game_id", "season", "game_date", "r.*"
    )


def current_ratings(ratings: DataFrame) -> DataFrame:
    """Rating to show now: before the next unplayed game, else after the last played one."""
    upcoming = ratings.where("elo_post IS NULL").groupBy("team_id").agg(
        F.min_by("elo_pre", F.struct("game_date", "game_id")).alias("next_elo")
    )
    played = ratings.where("elo_post IS NOT NULL").groupBy("team_id").agg(
        F.max_by("elo_post", F.struct("game_date", "game_id")).alias("last_elo")
    )
    return played.join(upcoming, "team_id", "full_outer").select(
        "team_id", F.coalesce("next_elo", "last_elo").alias("elo")
    )
