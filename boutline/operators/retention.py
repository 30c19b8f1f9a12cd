"""Thinning and dropping live history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.operators.running import CHUNK_ROWS, row_numbers


def thin(points: DataFrame, games: DataFrame, keep: int | None) -> DataFrame:
    """Points that stay; all if `keep` is None or 0. Of a finished game with more than `keep` points per source, the first at
    or past each of `keep` evenly spaced marks, and the last. Other games are untouched."""
    if not keep:
        return points
    series = ["game_id", "source"]
    finished = games.where("status = 'final'").select("game_id")
    ranked = row_numbers(
        points.join(finished, "game_id", "left_semi"),
        series,
        F.floor(F.col("action_id") / CHUNK_ROWS),
        ["action_id", "id"],
        name="__rn",
    )
    sizes = points.groupBy(*series).agg(F.count(F.lit(1)).alias("__n"))
    ranked = ranked.join(sizes, series)
    i, n = F.col("__rn") - 1, F.col("__n")
    mark = F.floor(F.try_divide(i.cast("double") * (keep - 1), n - 1))
    before = F.floor(F.try_divide((i - 1).cast("double") * (keep - 1), n - 1))
    stays = (n <= keep) | (i == n - 1) | (mark != before)
    thinned = ranked.where(stays).select(*points.columns)
    return thinned.unionByName(points.join(finished, "game_id", "left_anti"))


def drop_old(points: DataFrame, games: DataFrame, current: int, seasons: int | None) -> DataFrame:
    """Drop the points of games older than the last `seasons` seasons, whatever their status; none
    if `seasons` is None or 0."""
    if not seasons:
        return points
    old = games.where(F.col("season") < current - seasons + 1).select("game_id")
    return points.join(old, "game_id", "left_anti")


def prune(points: DataFrame, games: DataFrame, keep: int | None, current: int, seasons: int | None) -> DataFrame:
    return drop_old(thin(points, games, keep), games, current, seasons)
