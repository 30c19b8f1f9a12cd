"""Seasons, dates, timestamps and status codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEASON_START_MONTH = 8
EASTERN = "America/New_York"

# Game-id prefix -> modelled game type; every other prefix is dropped.
SEASON_TYPE_BY_PREFIX = {"002": "regular", "004": "playoffs", "005": "playin"}
# Status codes of the two feeds.
NUMERIC_STATUS = {1: "scheduled", 2: "live", 3: "final"}
TEXT_STATUS = {"pre": "scheduled", "in": "live", "post": "final"}


def lookup(value: Column, table: dict, default: Column | None = None) -> Column:
    """A small constant table as a CASE chain."""
    expr = None
    for key, result in table.items():
        branch = (value == F.lit(key), F.lit(result))
        expr = F.when(*branch) if expr is None else expr.when(*branch)
    return expr if default is None else expr.otherwise(default)


def season_type_of(game_id: Column) -> Column:
    return lookup(F.substring(game_id, 1, 3), SEASON_TYPE_BY_PREFIX)


def season_of(day: Column) -> Column:
    """Start year of the season a date belongs to (August cut)."""
    return F.year(day) - (F.month(day) < SEASON_START_MONTH).cast("int")


def season_label(season: Column) -> Column:
    """2024 -> '2024-25'."""
    return F.format_string("%d-%02d", season.cast("int"), F.pmod(season.cast("int") + 1, F.lit(100)))


def parse_season(text: Column) -> Column:
    """'2024' or '2024-25' -> 2024; a label whose end year does not follow is NULL."""
    start = F.regexp_extract(text, r"^(\d+)(-.*)?$", 1)
    year = F.when(start != "", start.try_cast("int"))
    has_end = F.regexp_extract(text, r"^\d+-(.+)$", 1) != ""
    return F.when(~has_end | (season_label(year) == text), year)


def parse_utc(text: Column) -> Column:
    """Tolerant ISO timestamp, seconds optional; empty or malformed text is NULL."""
    full = F.regexp_replace(F.trim(text), r"([T ]\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})?$", "$1:00$2")
    return F.try_to_timestamp(F.when(full != "", full))


def eastern_date(instant: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant.cast("timestamp"), EASTERN))


def numeric_status(code: Column) -> Column:
    return lookup(code, NUMERIC_STATUS, F.lit("scheduled"))


def text_status(state: Column) -> Column:
    return lookup(state, TEXT_STATUS, F.lit("scheduled"))


def score_if_started(status: Column, score: Column) -> Column:
    return F.when(status != "scheduled", score)


def made_before_tip(now: Column, tip: Column, game_date: Column) -> Column:
    return F.when(tip.isNotNull(), now < tip).otherwise(eastern_date(now) < game_date)


LATE_GAMES_END = 4  # o'clock, local: until then the games of the day before may still be on


def board_days(ts: Column) -> Column:
    """The board days to read at a moment: today's and, in the small hours, yesterday's."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), EASTERN)
    today = F.to_date(local)
    return F.when(F.hour(local) < LATE_GAMES_END, F.array(today, F.date_sub(today, 1))).otherwise(F.array(today))
