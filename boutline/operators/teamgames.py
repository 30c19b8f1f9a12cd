"""Game rows to team rows, box pairing, sites."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.functions.box import COMPONENTS, OPPONENT, OWN, possessions
from boutline.session import dealt


@dataclass(frozen=True)
class SharedSite:
    """A season that finished at one neutral place: from `start`, every game was played there."""

    season: int
    start: date
    lat: float
    lon: float


def prepare_games(
    games: DataFrame, arenas: DataFrame, relocations: DataFrame, shared: SharedSite | None = None
) -> DataFrame:
    """Neutral and playoff flags, and the site each game was played at."""
    inside = F.lit(False)
    if shared is not None:
        inside = (F.col("season") == shared.season) & (F.col("game_date") >= F.lit(shared.start))
    moved = relocations.select(
        F.col("team_id").alias("home_team_id"),
        F.col("season"),
        F.col("lat").alias("moved_lat"),
        F.col("lon").alias("moved_lon"),
    )
    home = arenas.select(
        F.col("team_id").alias("home_team_id"), F.col("lat").alias("arena_lat"), F.col("lon").alias("arena_lon")
    )
    # Dimension joins carry no hint: Spark broadcasts them only below its size threshold.
    sited = games.join(moved, ["home_team_id", "season"], "left").join(home, "home_team_id", "left")
    lat, lon = F.coalesce("moved_lat", "arena_lat"), F.coalesce("moved_lon", "arena_lon")
    if shared is not None:
        lat = F.when(inside, F.lit(shared.lat)).otherwise(lat)
        lon = F.when(inside, F.lit(shared.lon)).otherwise(lon)
    return sited.select(
        *[c for c in games.columns if c != "is_neutral"],
        (F.coalesce("is_neutral", F.lit(False)) | inside).alias("is_neutral"),
        (F.col("season_type") == "playoffs").alias("is_playoffs"),
        lat.alias("site_lat"),
        lon.alias("site_lon"),
    )


def pair_opponents(stats: DataFrame) -> DataFrame:
    """Each team's box beside its opponent's: equal game, different team."""
    mine = stats.select("game_id", "team_id", *OWN)
    theirs = stats.select(
        "game_id", F.col("team_id").alias("opp_team_id"), *[F.col(c).alias(f"opp_{c}") for c in OPPONENT]
    )
    paired = mine.join(theirs, "game_id").where("team_id <> opp_team_id").drop("opp_team_id")
    return paired.withColumn("poss", possessions())


def team_games(games: DataFrame) -> DataFrame:
    """Two rows per game, one from each team's side, from a single scan."""

    def side(own: str, other: str) -> F.Column:
        return F.struct(
            F.col(f"{own}_team_id").alias("team_id"),
            F.col(f"{other}_team_id").alias("opp_id"),
            F.col(f"{own}_score").alias("score"),
            F.col(f"{other}_score").alias("opp_score"),
            F.lit(own == "home").alias("is_home"),
        )

    used = {"home_team_id", "away_team_id", "home_score", "away_score"}
    base = [c for c in games.columns if c not in used]
    rows = games.select(*base, F.explode(F.array(side("home", "away"), side("away", "home"))).alias("t"))
    return rows.select(*base, "t.*").withColumn(
        "win", F.when(F.col("status") == "final", (F.col("score") > F.col("opp_score")).cast("int"))
    )


def team_games_with_box(games: DataFrame, stats: DataFrame, tasks: int | None = None) -> DataFrame:
    """U1 with J1 and J2 folded in: team rows of every game, carrying the box components of both
    sides where both teams' boxes exist (`has_box`).

    Box rows are brought to their game with one shuffle by game and folded into the game row;
    opponent columns are then just the other half of that row, so no self-join is needed."""
    box = stats.select("game_id", F.col("team_id").alias("__team"), *OWN)
    wide = (
        dealt(games, tasks, "game_id")
        .join(dealt(box, tasks, "game_id"), "game_id", "left")
        .groupBy(*games.columns)
        .agg(
            *[
                F.expr(f"max(CASE WHEN __team = {side}_team_id THEN {c} END) AS __{side}_{c}")
                for side in ("home", "away")
                for c in OWN
            ]
        )
    )

    def side(own: str, other: str) -> str:
        fields = {
            "team_id": f"{own}_team_id",
            "opp_id": f"{other}_team_id",
            "score": f"{own}_score",
            "opp_score": f"{other}_score",
            "is_home": str(own == "home").lower(),
            "has_box": "__home_minutes IS NOT NULL AND __away_minutes IS NOT NULL",
            **{c: f"__{own}_{c}" for c in OWN},
            **{f"opp_{c}": f"__{other}_{c}" for c in OPPONENT},
            "win": f"CASE WHEN status = 'final' THEN CAST({own}_score > {other}_score AS INT) END",
        }
        return "struct(" + ", ".join(f"{e} AS {n}" for n, e in fields.items()) + ")"

    used = {"home_team_id", "away_team_id", "home_score", "away_score"}
    base = [c for c in games.columns if c not in used]
    rows = wide.selectExpr(*base, f"explode(array({side('home', 'away')}, {side('away', 'home')})) AS t")
    return rows.select(*base, "t.*")


__all__ = [
    "COMPONENTS",
    "SharedSite",
    "pair_opponents",
    "prepare_games",
    "team_games",
    "team_games_with_box",
]
