"""Game clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Game shape.
PERIOD_SECONDS = 720
OVERTIME_SECONDS = 300
REGULATION_PERIODS = 4
GAME_SECONDS = PERIOD_SECONDS * REGULATION_PERIODS

ISO_CLOCK = r"^PT(\d+)M(\d+(?:\.\d+)?)S$"


def parse_iso_clock(text: Column) -> Column:
    """'PT11M43.00S' -> 703.0; anything else -> 0.0."""
    minutes = F.regexp_extract(text, ISO_CLOCK, 1)
    seconds = F.regexp_extract(text, ISO_CLOCK, 2)
    return F.coalesce(
        F.when(minutes != "", minutes.try_cast("double") * 60 + seconds.try_cast("double")), F.lit(0.0)
    )


def parse_display_clock(text: Column) -> Column:
    """'11:35' (minutes:seconds) or '45.3' (seconds); anything else -> 0.0."""
    numeric = r"^\s*\d+(\.\d*)?\s*$"
    minutes = F.regexp_extract(text, r"^(\d+):(\d+(?:\.\d+)?)$", 1)
    seconds = F.regexp_extract(text, r"^(\d+):(\d+(?:\.\d+)?)$", 2)
    return F.coalesce(
        F.when(minutes != "", minutes.try_cast("double") * 60 + seconds.try_cast("double")),
        F.when(text.rlike(numeric), F.trim(text).try_cast("double")),
        F.lit(0.0),
    )


def seconds_remaining(period: Column, clock: Column) -> Column:
    """Seconds left in regulation, or in the current overtime."""
    return F.when(
        period <= REGULATION_PERIODS, (REGULATION_PERIODS - period) * PERIOD_SECONDS + clock
    ).otherwise(clock)


def elapsed_seconds(period: Column, clock: Column) -> Column:
    """Game time since tip-off, overtime included."""
    return F.when(period <= REGULATION_PERIODS, period * PERIOD_SECONDS - clock).otherwise(
        GAME_SECONDS + (period - REGULATION_PERIODS) * OVERTIME_SECONDS - clock
    )
