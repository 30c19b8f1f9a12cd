"""Probabilities, in-game model inputs and metric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boutline.functions.clock import GAME_SECONDS

PROB_EPS = 1e-3  # fixed value: clip bound
INPUTS = [
    "score_diff",
    "seconds_remaining",
    "diff_per_sqrt_time",
    "possession",
    "pregame_logit",
    "pregame_logit_x_time",
    "period",
]


def clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(PROB_EPS)), F.lit(1 - PROB_EPS))


def logit(p: Column) -> Column:
    return F.log(clip(p) / (1 - clip(p)))


def state_inputs(pregame_prob: Column) -> dict[str, Column]:
    """Model inputs from state columns and the pre-game estimate."""
    diff = (F.col("score_home") - F.col("score_away")).cast("double")
    left = F.greatest(F.col("seconds_remaining"), F.lit(0.0)).cast("double")
    pre = logit(pregame_prob.cast("double"))
    return {
        "score_diff": diff,
        "seconds_remaining": left,
        "diff_per_sqrt_time": diff / F.sqrt(left + 1),
        "possession": F.col("possession").cast("double"),
        "pregame_logit": pre,
        "pregame_logit_x_time": pre * left / GAME_SECONDS,
        "period": F.col("period").cast("double"),
    }


def settle(p: Column, score_diff: Column, remaining: Column, period: Column) -> Column:
    """Exactly 0 or 1 once the clock has run out in the last period with a lead."""
    over = (remaining <= 0) & (score_diff != 0) & (period >= 4)
    return F.when(over, (score_diff > 0).cast("double")).otherwise(p)


def log_loss_term(y: Column, p: Column) -> Column:
    return -(y * F.log(clip(p)) + (1 - y) * F.log(1 - clip(p)))


def brier_term(y: Column, p: Column) -> Column:
    return F.pow(p - y, 2)


def hit_term(y: Column, p: Column) -> Column:
    return ((p >= 0.5) == (y == 1)).cast("double")


def bin_of(p: Column, bins: int = 10) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
