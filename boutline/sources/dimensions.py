"""Static dimensions (S9): teams, home sites, seasons played elsewhere, provider ids."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.operators.teamgames import SharedSite

# Team id, abbreviation, city, nickname, home latitude, longitude, second provider's id.
TEAMS = [
    (1610612737, "ATL", "Atlanta", "Hawks", 33.757, -84.396, "1"),
    (1610612738, "BOS", "Boston", "Celtics", 42.366, -71.062, "2"),
    (1610612739, "CLE", "Cleveland", "Cavaliers", 41.496, -81.688, "5"),
    (1610612740, "NOP", "New Orleans", "Pelicans", 29.949, -90.082, "3"),
    (1610612741, "CHI", "Chicago", "Bulls", 41.881, -87.674, "4"),
    (1610612742, "DAL", "Dallas", "Mavericks", 32.790, -96.810, "6"),
    (1610612743, "DEN", "Denver", "Nuggets", 39.749, -105.008, "7"),
    (1610612744, "GSW", "Golden State", "Warriors", 37.768, -122.388, "9"),
    (1610612745, "HOU", "Houston", "Rockets", 29.751, -95.362, "10"),
    (1610612746, "LAC", "Los Angeles", "Clippers", 34.043, -118.267, "12"),
    (1610612747, "LAL", "Los Angeles", "Lakers", 34.043, -118.267, "13"),
    (1610612748, "MIA", "Miami", "Heat", 25.781, -80.188, "14"),
    (1610612749, "MIL", "Milwaukee", "Bucks", 43.045, -87.917, "15"),
    (1610612750, "MIN", "Minnesota", "Timberwolves", 44.979, -93.276, "16"),
    (1610612751, "BKN", "Brooklyn", "Nets", 40.683, -73.975, "17"),
    (1610612752, "NYK", "New York", "Knicks", 40.750, -73.993, "18"),
    (1610612753, "ORL", "Orlando", "Magic", 28.539, -81.384, "19"),
    (1610612754, "IND", "Indiana", "Pacers", 39.764, -86.155, "11"),
    (1610612755, "PHI", "Philadelphia", "76ers", 39.901, -75.172, "20"),
    (1610612756, "PHX", "Phoenix", "Suns", 33.446, -112.071, "21"),
    (1610612757, "POR", "Portland", "Trail Blazers", 45.532, -122.667, "22"),
    (1610612758, "SAC", "Sacramento", "Kings", 38.580, -121.500, "23"),
    (1610612759, "SAS", "San Antonio", "Spurs", 29.427, -98.437, "24"),
    (1610612760, "OKC", "Oklahoma City", "Thunder", 35.463, -97.515, "25"),
    (1610612761, "TOR", "Toronto", "Raptors", 43.643, -79.379, "28"),
    (1610612762, "UTA", "Utah", "Jazz", 40.768, -111.901, "26"),
    (1610612763, "MEM", "Memphis", "Grizzlies", 35.138, -90.051, "29"),
    (1610612764, "WAS", "Washington", "Wizards", 38.898, -77.021, "27"),
    (1610612765, "DET", "Detroit", "Pistons", 42.341, -83.055, "8"),
    (1610612766, "CHA", "Charlotte", "Hornets", 35.225, -80.839, "30"),
]
# Team id, season, latitude, longitude of home games played elsewhere.
RELOCATIONS = [
    (1610612760, 2004, 47.622, -122.354),
    (1610612760, 2005, 47.622, -122.354),
    (1610612760, 2006, 47.622, -122.354),
    (1610612760, 2007, 47.622, -122.354),
    (1610612740, 2005, 35.463, -97.515),
    (1610612740, 2006, 35.463, -97.515),
]
# The season that finished at one neutral site.
SHARED_SITE = SharedSite(season=2019, start=date(2020, 7, 30), lat=28.539, lon=-81.384)


def team_table(spark: SparkSession) -> DataFrame:
    rows = [(i, abbr, city, nick, f"{city} {nick}", lat, lon, pid) for i, abbr, city, nick, lat, lon, pid in TEAMS]
    return spark.createDataFrame(
        rows,
        "team_id long, abbreviation string, city string, nickname string, full_name string, "
        "lat double, lon double, provider_team_id string",
    )


def teams(spark: SparkSession) -> DataFrame:
    return team_table(spark).select("team_id", "abbreviation", "city", "nickname", "full_name")


def arenas(spark: SparkSession) -> DataFrame:
    return team_table(spark).select("team_id", "lat", "lon")


def provider_teams(spark: SparkSession) -> DataFrame:
    return team_table(spark).select("provider_team_id", "team_id")


def relocations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELOCATIONS, "team_id long, season int, lat double, lon double")


def provider_team_id(code: F.Column) -> F.Column:
    """Provider team code -> team id as a constant map (30 entries), so parsing needs no join."""
    entries = [x for row in TEAMS for x in (F.lit(row[6]), F.lit(row[0]))]
    return F.try_element_at(F.create_map(*entries), code)
