"""Acceptance and promotion rules, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG_PREFIX = "backtest_logloss_"


def season_tag(season: Column) -> Column:
    return F.concat(F.lit(TAG_PREFIX), season.cast("string"))


def heldout_logloss(tags: Column) -> Column:
    """Log loss on the newest season a version was evaluated on, from its tags."""
    keys = F.filter(F.map_keys(tags), lambda k: k.startswith(TAG_PREFIX))
    return F.try_element_at(tags, F.array_max(keys)).try_cast("double")


def promotion(candidates: DataFrame, production: DataFrame) -> DataFrame:
    """Should each candidate replace the production version of its name?

    `candidates`: name, season, logloss, failed (names of failed checks). `production`: name,
    version, tags. A rating only has to be strictly better on the same season."""
    current = production.select("name", F.col("version").alias("__version"), F.col("tags").alias("__tags"))
    joined = candidates.join(current, "name", "left")
    theirs = F.try_element_at("__tags", season_tag(F.col("season"))).try_cast("double")
    better = F.col("logloss") < theirs
    has_failed = F.size("failed") > 0
    none_yet, unknown = F.col("__version").isNull(), theirs.isNull()
    against = F.format_string(" production v%s %.4f", F.col("__version"), theirs)
    ours = F.format_string("log loss %.4f", F.col("logloss"))
    reason = (
        F.when(has_failed, F.concat(F.lit("failed acceptance: "), F.array_join("failed", ", ")))
        .when(none_yet, "no production model yet")
        .when(unknown, F.format_string("production v%s was not evaluated on %d", F.col("__version"), F.col("season")))
        .when(better, F.concat(ours, F.lit(" <"), against))
        .otherwise(F.concat(ours, F.lit(" >="), against))
    )
    promote = ~has_failed & (none_yet | unknown | F.coalesce(better, F.lit(False)))
    return joined.select(*candidates.columns, promote.alias("promote"), reason.alias("reason"))


def snapshot_versions(used: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Reports of used versions that are not stored yet."""
    return used.join(snapshots.select("version"), "version", "left_anti")


def report_lines(metrics: DataFrame) -> DataFrame:
    """One text line per season, pooled last: model (baseline) per metric."""
    sides = metrics.groupBy("season").agg(
        *[
            F.max(F.when(F.col("variant") == v, F.col(m))).alias(f"{v}_{m}")
            for v in ("model", "elo")
            for m in ("logloss", "brier", "accuracy", "ece")
        ]
    )
    label = F.coalesce(F.col("season").cast("string"), F.lit("pooled"))
    text = F.format_string(
        "%-7s  %.4f (%.4f)   %.4f (%.4f)   %.3f (%.3f)    %.3f",
        label,
        *[F.col(f"{v}_{m}") for m in ("logloss", "brier", "accuracy") for v in ("model", "elo")],
        F.col("model_ece"),
    )
    return sides.select("season", text.alias("line"))
