"""Rating arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rating constants.
INITIAL = 1500.0
K = 20.0
HOME_ADVANTAGE = 100.0
SEASON_CARRYOVER = 0.75
SEASON_MEAN = 1505.0


def win_probability(diff: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -diff / 400.0))


def home_offset(is_neutral: Column) -> Column:
    return F.when(F.coalesce(is_neutral, F.lit(False)), 0.0).otherwise(HOME_ADVANTAGE)


def regress_to_mean(rating: Column) -> Column:
    return SEASON_CARRYOVER * rating + (1.0 - SEASON_CARRYOVER) * SEASON_MEAN


def margin_multiplier(margin: Column, winner_diff: Column) -> Column:
    return F.pow(F.abs(margin) + 3.0, F.lit(0.8)) / (7.5 + 0.006 * winner_diff)


def home_win_probability(home: Column, away: Column, is_neutral: Column) -> Column:
    return win_probability(home + home_offset(is_neutral) - away)


def rating_shift(home: Column, away: Column, margin: Column, is_neutral: Column) -> Column:
    """Points the home team gains (and the away team loses); a margin <= 0 is an away win."""
    diff = home + home_offset(is_neutral) - away
    won = margin > 0
    winner_diff = F.when(won, diff).otherwise(-diff)
    return K * margin_multiplier(margin, winner_diff) * (won.cast("double") - win_probability(diff))
