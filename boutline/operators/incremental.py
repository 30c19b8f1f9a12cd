"""Features that follow what changed (S13, W13): which games a changed game touches, and their rows
computed from just the team seasons they need.

A game's form columns depend on its own row, on earlier games of both teams in its season, on the
season before (closing form) and on the last seven days. So a changed game touches, for both
teams it has or had: its season from its day on, and the whole season after. That holds while each
team's seasons follow each other in time (`seasons_in_order`); otherwise build everything.
Ratings reach further and come from `ratings.rate_since`; rows they alone move are patched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutline.functions.box import OWN
from boutline.operators.features import GAME_COLUMNS, GAME_FEATURES, join_features, wide_form

LOAD_DAYS = 7
SIDES = ("home", "away")
INPUT_COLUMNS = ["game_id", "season", "game_date", "home_team_id", "away_team_id", "digest"]


def feature_inputs(prepared: DataFrame, stats: DataFrame) -> DataFrame:
    """(INPUT_COLUMNS): a digest per game of all that its own row and its box scores give to features."""
    box = stats.groupBy("game_id").agg(
        F.md5(F.to_json(F.array_sort(F.collect_list(F.struct("team_id", *OWN))))).alias("box")  # two rows a game
    )
    own = F.to_json(F.struct(*GAME_COLUMNS, *GAME_FEATURES, "site_lat", "site_lon", "box"))
    return prepared.join(box, "game_id", "left").withColumn("digest", F.md5(own)).select(*INPUT_COLUMNS)


def changed_games(now: DataFrame, before: DataFrame) -> DataFrame:
    """Games that are new, gone or not what they were, with what they are and were (`now`, `was`)."""
    new = now.select("game_id", F.struct(*INPUT_COLUMNS[1:]).alias("now"))
    old = before.select("game_id", F.struct(*INPUT_COLUMNS[1:]).alias("was"))
    return new.join(old, "game_id", "full_outer").where(~F.col("now.digest").eqNullSafe(F.col("was.digest")))


def _team_days(inputs: DataFrame) -> DataFrame:
    teams = F.explode(F.array(*[F.col(f"{s}_team_id") for s in SIDES])).alias("team_id")
    return inputs.select("game_id", "season", "game_date", teams)


def seasons_in_order(*inputs: DataFrame) -> bool:
    """Whether each team's seasons follow each other, those two apart more than a week apart."""
    rows = _team_days(inputs[0])
    for more in inputs[1:]:
        rows = rows.unionByName(_team_days(more))
    spans = rows.groupBy("team_id", "season").agg(F.min("game_date").alias("a"), F.max("game_date").alias("b"))
    order = Window.partitionBy("team_id").orderBy("season")  # a row a season
    last = lambda n: F.lag(F.struct("season", "b"), n).over(order)
    spans = spans.select("*", last(1).alias("p1"), last(2).alias("p2"))
    wrong = F.col("team_id").isNull() | F.col("season").isNull() | F.col("a").isNull() | (F.col("p1.b") >= F.col("a"))
    for p in ("p1", "p2"):
        near = F.datediff("a", f"{p}.b") <= LOAD_DAYS
        wrong = wrong | ((F.col("season") - F.col(f"{p}.season") > 1) & near)
    return spans.where(F.coalesce(wrong, F.lit(False))).isEmpty()


def touched_games(inputs: DataFrame, changed: DataFrame) -> DataFrame:
    """(game_id, season) of the games whose form columns the changed games may move."""
    sides = changed.select(F.explode(F.array("now", "was")).alias("g")).where("g IS NOT NULL").select("g.*")
    sides = sides.withColumn("game_id", F.lit(""))
    from_day = F.array(
        F.struct(F.col("season"), F.col("game_date").alias("day")),
        F.struct((F.col("season") + 1).alias("season"), F.lit(None).cast("date").alias("day")),
    )
    marks = _team_days(sides).select("team_id", F.explode(from_day).alias("m")).select("team_id", "m.*")
    # One row a team and season: NULL, the whole season, is the earliest of all days.
    marks = marks.groupBy("team_id", "season").agg(
        F.when(F.count("day") == F.count(F.lit(1)), F.min("day")).alias("day")
    )
    hit = _team_days(inputs).join(marks, ["team_id", "season"]).where("day IS NULL OR game_date >= day")
    return hit.select("game_id", "season").distinct()


def needed_games(prepared: DataFrame, touched: DataFrame) -> DataFrame:
    """The prepared games from which the touched ones follow: the seasons of both their teams and
    the seasons before."""
    rows = _team_days(prepared).join(touched.select("game_id"), "game_id", "left_semi")
    need = rows.select("team_id", F.explode(F.array(F.col("season"), F.col("season") - 1)).alias("season")).distinct()
    games = _team_days(prepared).join(need, ["team_id", "season"], "left_semi").select("game_id").distinct()
    return prepared.join(games, "game_id", "left_semi")


def touched_features(prepared: DataFrame, stats: DataFrame, rated: DataFrame, touched: DataFrame) -> DataFrame:
    """Features of the touched games, computed from the needed games alone."""
    games = needed_games(prepared, touched)
    boxes = stats.join(games.select("game_id"), "game_id", "left_semi")
    wanted = games.join(touched.select("game_id"), "game_id", "left_semi")
    return join_features(wanted, rated, wide_form(games, boxes))


def with_ratings(rows: DataFrame, rated: DataFrame) -> DataFrame:
    """Feature rows with the ratings, and the difference of them, that `rated` has."""
    fresh = rated.select("game_id", *[F.col(f"{s}_elo_pre").alias(f"__{s}") for s in SIDES])
    joined = rows.join(fresh, "game_id")
    values = {f"{s}_elo_pre": F.col(f"__{s}") for s in SIDES} | {"diff_elo_pre": F.col("__home") - F.col("__away")}
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in rows.columns])

