"""Event streams to game states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.functions.clock import PERIOD_SECONDS, elapsed_seconds, seconds_remaining
from boutline.functions.prob import state_inputs
from boutline.operators.running import CHUNK_ROWS, running

# Event types that never change a state.
NOISE_EVENTS = ["Substitution", "Timeout", "Instant Replay"]
STATE_COLUMNS = [
    "game_id", "action_id", "period", "clock_seconds", "score_home", "score_away", "possession", "description",
]


def is_kept(action_type: Column) -> Column:
    """Noise filter; events without a type are kept."""
    return ~F.coalesce(action_type, F.lit("")).isin(NOISE_EVENTS)


def possession_outcome(
    action_type: Column, sub_type: Column, location: Column, description: Column
) -> Column:
    """Who has the ball after an event (1 home, -1 away, 0 unknown); NULL = as before."""
    side = F.when(location == "h", 1).when(location == "v", -1)
    sub, text = F.coalesce(sub_type, F.lit("")), F.coalesce(description, F.lit(""))
    number, of = (F.regexp_extract(sub, r"(\d+) of (\d+)", i) for i in (1, 2))
    free_throw = (
        F.when(sub.contains("Technical"), F.lit(None).cast("int"))
        .when((number == "") | (number.try_cast("int") < of.try_cast("int")), side)
        .when(sub.contains("Flagrant") | sub.contains("Clear Path"), side)
        .when(text.startswith("MISS"), F.lit(0))
        .otherwise(-side)
    )
    return (
        F.when(action_type.isin("period", "Jump Ball"), F.lit(0))
        .when(side.isNull(), F.lit(None).cast("int"))
        .when(action_type.isin("Made Shot", "Turnover"), -side)
        .when(action_type == "Missed Shot", F.lit(0))
        .when(action_type == "Rebound", side)
        .when(action_type == "Free Throw", free_throw)
    )


def game_states(events: DataFrame) -> DataFrame:
    """One state after each kept event, in `action_id` order. Each rule gives a constant or
    "as before", so possession is the last constant carried forward: no UDF, and a game with
    very many events spreads over chunks."""
    kept = events.where(is_kept(F.col("action_type")))
    outcome = possession_outcome(*(F.col(c) for c in ("action_type", "sub_type", "location", "description")))
    carried = running(
        kept.drop("possession"),
        ["game_id"],
        F.floor(F.col("action_id") / CHUNK_ROWS),
        ["action_id"],
        lasts={"possession": outcome},
    )
    return carried.withColumn("possession", F.coalesce("possession", F.lit(0))).select(*STATE_COLUMNS)


def tip_off(games: DataFrame) -> DataFrame:
    """The synthetic opening state of each game in `games`."""
    return games.select(
        "game_id",
        F.lit(0).cast("long").alias("action_id"),
        F.lit(1).alias("period"),
        F.lit(float(PERIOD_SECONDS)).alias("clock_seconds"),
        F.lit(0).alias("score_home"),
        F.lit(0).alias("score_away"),
        F.lit(0).alias("possession"),
        F.lit("Tip-off").alias("description"),
    )


def with_times(states: DataFrame) -> DataFrame:
    period, clock = F.col("period"), F.col("clock_seconds")
    return states.select(
        "*",
        seconds_remaining(period, clock).cast("double").alias("seconds_remaining"),
        elapsed_seconds(period, clock).cast("double").alias("elapsed_seconds"),
    )


def states_with_tip_off(events: DataFrame) -> DataFrame:
    states = game_states(events)
    opening = tip_off(states.select("game_id").distinct())
    casts = [opening[c].cast(states.schema[c].dataType).alias(c) for c in STATE_COLUMNS]
    return with_times(states.unionByName(opening.select(*casts)))


def prune_descriptions(events: DataFrame) -> DataFrame:
    """Keep four letters of free-throw text, nothing of other descriptions."""
    short = F.when(F.col("action_type") == "Free Throw", F.left(F.col("description"), F.lit(4)))
    return events.withColumn("description", short)


def training_states(events: DataFrame, games: DataFrame, pregame: DataFrame) -> DataFrame:
    """Every state of finished games with its out-of-sample pre-game estimate and label, as one
    plan over all seasons; games without an estimate drop out (M9, J13, U4)."""
    finished = games.where(F.col("status") == "final").select(
        "game_id", "season", (F.col("home_score") > F.col("away_score")).cast("int").alias("home_win")
    )
    usable = finished.join(pregame.select("game_id", "pregame_prob"), "game_id")
    mine = events.select(
        "game_id", "action_id", "period", "clock_seconds", "location", "action_type", "sub_type",
        "score_home", "score_away", "description",
    ).join(usable.select("game_id"), "game_id", "left_semi")
    states = states_with_tip_off(prune_descriptions(mine)).drop("description")
    return states.join(usable, "game_id")


def with_inputs(states: DataFrame, pregame_prob: str = "pregame_prob") -> DataFrame:
    """Add the model inputs under their own names (prefix `x_`)."""
    inputs = state_inputs(F.col(pregame_prob))
    return states.select("*", *[e.alias(f"x_{n}") for n, e in inputs.items()])


def forward_fill_scores(feed: DataFrame, order: str = "pos") -> DataFrame:
    """Raw feeds carry scores only on scoring plays; carry them forward from 0-0."""
    scored = F.col("raw_score_home").isNotNull() & (F.col("raw_score_home") != "")
    filled = running(
        feed,
        ["game_id"],
        F.floor(F.col(order) / CHUNK_ROWS),
        [order],
        lasts={
            "score_home": F.when(scored, F.col("raw_score_home").try_cast("int")),
            "score_away": F.when(scored, F.col("raw_score_away").try_cast("int")),
        },
    )
    return filled.select(
        *[c for c in filled.columns if c not in ("score_home", "score_away")],
        F.coalesce("score_home", F.lit(0)).alias("score_home"),
        F.coalesce("score_away", F.lit(0)).alias("score_away"),
    )
