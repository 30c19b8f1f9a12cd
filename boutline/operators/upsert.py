"""Keyed merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.operators.latest import latest_by


def request_key(source: Column, endpoint: Column, params: Column) -> Column:
    """Canonical key of a request: parameters as compact JSON with sorted names."""
    entries = F.map_from_entries(F.array_sort(F.map_entries(params)))
    return F.concat_ws(":", source, endpoint, F.to_json(entries))


def upsert(
    old: DataFrame,
    new: DataFrame,
    keys: list[str],
    guard: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    update: dict[str, Callable[[Callable[[str], Column], Callable[[str], Column]], Column]] | None = None,
) -> DataFrame:
    """Merge `new` into `old` on `keys`: only the columns `new` carries are touched (a NULL it
    carries is written). `guard(old, new)` must hold for a matched row to change; `update` gives
    columns computed from both rows when matched. `new` must be unique per key."""
    given = [c for c in new.columns if c not in keys]
    incoming = new.select(
        *keys, *[F.col(c).alias(f"__new_{c}") for c in given], F.lit(True).alias("__new")
    )
    present = old.withColumn("__old", F.lit(True))
    both = present.join(incoming, keys, "full_outer")

    def of_old(c: str) -> Column:
        return F.col(c)

    def of_new(c: str) -> Column:
        return F.col(f"__new_{c}")

    inserted = F.col("__old").isNull()
    accepted = F.col("__new").isNotNull()
    if guard is not None:
        accepted = accepted & (inserted | F.coalesce(guard(of_old, of_new), F.lit(False)))
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif update and c in update:
            fresh = F.when(inserted, of_new(c) if c in given else F.lit(None)).otherwise(update[c](of_old, of_new))
            out.append(F.when(accepted, fresh).otherwise(F.col(c)).alias(c))
        elif c in given:
            out.append(F.when(accepted, of_new(c)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def final_stays_final(old: Callable[[str], Column], new: Callable[[str], Column]) -> Column:
    return (old("status") != "final") | (new("status") == "final")


def upsert_games(old: DataFrame, new: DataFrame) -> DataFrame:
    """A finished game is never downgraded by a stale entry."""
    return upsert(old, new, ["game_id"], guard=final_stays_final)


def update_from_scoreboard(games: DataFrame, board: DataFrame) -> DataFrame:
    """Status and scores from the board for known games, never touching finished ones."""
    known = board.join(games.select("game_id"), "game_id", "left_semi").where("status <> 'scheduled'")
    return upsert(
        games,
        known.select("game_id", "status", "home_score", "away_score"),
        ["game_id"],
        guard=lambda old, new: old("status") != "final",
    )


def mark_tasks(ledger: DataFrame, marks: DataFrame) -> DataFrame:
    """Record task outcomes; a task seen before has its attempts counted up."""
    return upsert(
        ledger,
        marks.withColumn("attempts", F.lit(1).cast(ledger.schema["attempts"].dataType)),
        ["task_key"],
        update={"attempts": lambda old, new: old("attempts") + 1},
    )


def changed_predictions(scored: DataFrame, history: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Only predictions that differ from the latest stored one: another version, or a probability
    at least `tolerance` away (S16)."""
    latest = latest_by(
        history.select("game_id", "created_at", "id", "model_version", "home_win_prob"),
        ["game_id"],
        ["created_at", "id"],
    ).select("game_id", F.col("model_version").alias("__v"), F.col("home_win_prob").alias("__p"))
    same = (F.col("__v") == F.col("model_version")) & (
        F.abs(F.col("__p") - F.col("home_win_prob")) < tolerance
    )
    joined = scored.join(latest, "game_id", "left")
    return joined.where(~F.coalesce(same, F.lit(False))).drop("__v", "__p")


def resolve_ids(feed: DataFrame, games: DataFrame, prefix: str) -> DataFrame:
    """Our game id for each provider event: the row already linked to it, else the unlinked row
    with the same date and teams, else a new id (J12)."""
    linked = games.where("provider_id IS NOT NULL").select("provider_id", F.col("game_id").alias("__linked"))
    unlinked = games.where("provider_id IS NULL").groupBy("game_date", "home_team_id", "away_team_id").agg(
        F.max("game_id").alias("__matched")
    )
    joined = feed.join(linked, "provider_id", "left").join(
        unlinked, ["game_date", "home_team_id", "away_team_id"], "left"
    )
    minted = F.concat(F.lit(prefix), F.col("provider_id"))
    return joined.select(*feed.columns, F.coalesce("__linked", "__matched", minted).alias("game_id"))


def merge_points(current: DataFrame, points: DataFrame) -> DataFrame:
    """Snapshot plus updates, newest per (game, action) wins (J18). Both carry `arrival`."""
    return latest_by(current.unionByName(points), ["game_id", "action_id"], ["arrival"])
