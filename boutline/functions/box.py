"""Box-score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Box columns whose sums make up a team's form, and the opponent columns kept beside them.
OWN = ["pts", "minutes", "fgm", "fg3m", "fga", "fta", "ftm", "tov", "oreb", "dreb"]
OPPONENT = ["pts", "fgm", "fg3m", "fga", "fta", "ftm", "tov", "oreb", "dreb"]
COMPONENTS = OWN + [f"opp_{c}" for c in OPPONENT]

EARTH_RADIUS_KM = 6371.0

_POSSESSION = ["fga", "fta", "oreb", "tov", "opp_fga", "opp_fta", "opp_oreb", "opp_tov"]
# The summed components each rate is made of.
RATE_INPUTS = {
    "ortg": ["pts", *_POSSESSION],
    "drtg": ["opp_pts", *_POSSESSION],
    "net": ["pts", "opp_pts", *_POSSESSION],
    "pace": ["minutes", *_POSSESSION],
    "efg": ["fgm", "fg3m", "fga"],
    "tov_pct": ["tov", "fga", "fta"],
    "orb_pct": ["oreb", "opp_dreb"],
    "ftr": ["ftm", "fga"],
    "opp_efg": ["opp_fgm", "opp_fg3m", "opp_fga"],
    "opp_tov_pct": ["opp_tov", "opp_fga", "opp_fta"],
    "drb_pct": ["dreb", "opp_oreb"],
    "opp_ftr": ["opp_ftm", "opp_fga"],
}


def made_attempted(text: Column) -> tuple[Column, Column]:
    """'38-85' -> (38, 85)."""
    parts = F.split(text, "-")
    return parts.getItem(0).try_cast("int"), parts.getItem(1).try_cast("int")


def minutes_played(periods: Column) -> Column:
    """Team minutes from the number of periods: five players, five-minute overtimes."""
    return 240 + 25 * (F.greatest(F.lit(4), F.coalesce(periods, F.lit(4))) - 4)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    half = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon / 2), 2
    )
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(half))


# The rates below are written as SQL expressions: they are generated by the dozen, and one
# parsed text is far cheaper to build than a tree of column calls.


def possessions_sql(prefix: str = "") -> str:
    """Mean of both teams' estimates, from integer sums (so any summation order is exact)."""
    p = prefix
    return (
        f"(({p}fga + {p}opp_fga - {p}oreb - {p}opp_oreb + {p}tov + {p}opp_tov"
        f" + 0.44D * ({p}fta + {p}opp_fta)) / 2D)"
    )


def rate_sql(name: str, prefix: str = "") -> str:
    """One ratio-of-sums rate over summed components named `<prefix><component>`."""
    p = prefix
    if name == "net":
        return f"({rate_sql('ortg', p)} - {rate_sql('drtg', p)})"
    if name in ("orb_pct", "drb_pct"):
        own, theirs = ("oreb", "opp_dreb") if name == "orb_pct" else ("dreb", "opp_oreb")
        parts = f"{p}{own}", f"{p}{own} + {p}{theirs}"
    elif name in ("ortg", "drtg"):
        parts = f"100D * {p}{'pts' if name == 'ortg' else 'opp_pts'}", possessions_sql(p)
    elif name == "pace":
        parts = f"240D * {possessions_sql(p)}", f"{p}minutes"
    else:
        s = f"{p}opp_" if name.startswith("opp_") else p
        parts = {
            "efg": (f"{s}fgm + 0.5D * {s}fg3m", f"{s}fga"),
            "tov_pct": (f"{s}tov", f"{s}fga + 0.44D * {s}fta + {s}tov"),
            "ftr": (f"{s}ftm", f"{s}fga"),
        }[name.removeprefix("opp_")]
    return f"try_divide(CAST({parts[0]} AS DOUBLE), CAST({parts[1]} AS DOUBLE))"


def possessions() -> Column:
    return F.expr(possessions_sql())


def rates(prefix: str = "") -> dict[str, Column]:
    return {name: F.expr(rate_sql(name, prefix)) for name in RATE_INPUTS}
