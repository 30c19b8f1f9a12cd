"""Second provider: scoreboard, box score, plays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.functions.box import made_attempted, minutes_played
from boutline.functions.calendar import eastern_date, lookup, parse_utc, score_if_started, text_status
from boutline.functions.clock import parse_display_clock
from boutline.operators.latest import latest_by
from boutline.sources.dimensions import provider_team_id
from boutline.sources.documents import ARRIVAL, readable

SCOREBOARD = (
    "events array<struct<id: string, date: string, season: struct<year: int, type: int>, "
    "status: struct<type: struct<name: string, state: string>, period: int, displayClock: string>, "
    "competitions: array<struct<type: struct<abbreviation: string>, neutralSite: boolean, "
    "competitors: array<struct<homeAway: string, score: string, team: struct<id: string>>>>>>>"
)
SUMMARY = (
    "header struct<competitions: array<struct<competitors: array<struct<homeAway: string, score: string, "
    "team: struct<id: string>>>>>>, "
    "boxscore struct<teams: array<struct<team: struct<id: string>, "
    "statistics: array<struct<name: string, displayValue: string>>>>>, "
    "plays array<struct<type: struct<text: string>, text: string, scoringPlay: boolean, shootingPlay: boolean, "
    "scoreValue: int, team: struct<id: string>, period: struct<number: int>, clock: struct<displayValue: string>, "
    "homeScore: int, awayScore: int, sequenceNumber: string>>"
)

# The provider's codes.
SEASON_TYPES = {2: "regular", 3: "playoffs", 5: "playin"}
NOT_PLAYED = ["STATUS_POSTPONED", "STATUS_CANCELED"]
EXHIBITION = ["CC"]
PAIRS = {
    "fg": "fieldGoalsMade-fieldGoalsAttempted",
    "fg3": "threePointFieldGoalsMade-threePointFieldGoalsAttempted",
    "ft": "freeThrowsMade-freeThrowsAttempted",
}
COUNTS = {
    "oreb": "offensiveRebounds",
    "dreb": "defensiveRebounds",
    "reb": "totalRebounds",
    "ast": "assists",
    "stl": "steals",
    "blk": "blocks",
    "pf": "fouls",
}


def parse_scoreboard(docs: DataFrame) -> DataFrame:
    """Modelled games of scoreboards: no preseason, open slots, postponed or exhibition games. A
    game on several boards is as the newest has it."""
    ev = readable(docs, "events").select(*ARRIVAL, F.explode("events").alias("e"))
    comp = F.col("e.competitions")[0]

    def team(side: str) -> F.Column:
        return F.get(F.filter(comp["competitors"], lambda c: c["homeAway"] == side), 0)

    status = text_status(F.col("e.status.type.state"))
    tip = parse_utc(F.col("e.date"))
    rows = ev.select(
        *ARRIVAL,
        F.col("e.id").alias("provider_id"),
        (F.col("e.season.year") - 1).alias("season"),
        lookup(F.col("e.season.type"), SEASON_TYPES).alias("season_type"),
        eastern_date(tip).alias("game_date"),
        tip.alias("tip_time_utc"),
        provider_team_id(team("home")["team"]["id"]).alias("home_team_id"),
        provider_team_id(team("away")["team"]["id"]).alias("away_team_id"),
        status.alias("status"),
        score_if_started(status, team("home")["score"].try_cast("int")).alias("home_score"),
        score_if_started(status, team("away")["score"].try_cast("int")).alias("away_score"),
        F.coalesce(comp["neutralSite"], F.lit(False)).alias("is_neutral"),
        F.coalesce("e.status.period", F.lit(0)).alias("period"),
        F.coalesce("e.status.displayClock", F.lit("")).alias("clock"),
        F.coalesce(F.col("e.status.type.name"), F.lit("")).alias("__name"),
        F.coalesce(comp["type"]["abbreviation"], F.lit("")).alias("__kind"),
    )
    modelled = F.col("season_type").isNotNull() & F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull()
    played = ~F.col("__name").isin(NOT_PLAYED) & ~F.col("__kind").isin(EXHIBITION)
    return latest_by(rows.where(modelled & played).drop("__name", "__kind"), ["provider_id"], ARRIVAL).drop("fetched")


def _home_code() -> F.Column:
    competitors = F.col("header.competitions")[0]["competitors"]
    return F.get(F.filter(competitors, lambda c: c["homeAway"] == "home"), 0)["team"]["id"]


def parse_box(summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(team box rows, rejects) of game summaries; `summaries` carries `game_id`. The margin is
    taken from the pair of final scores."""
    docs = readable(summaries, "boxscore")
    competitors = F.col("header.competitions")[0]["competitors"]
    periods = F.array_max(F.transform(F.coalesce("plays", F.array()), lambda p: p["period"]["number"]))
    rows = docs.select(
        "game_id",
        "document",
        _home_code().alias("home_code"),
        competitors.alias("competitors"),
        minutes_played(periods).alias("minutes"),
        F.explode("boxscore.teams").alias("t"),
    )

    def stat(name: str) -> F.Column:
        return F.try_element_at(F.filter("t.statistics", lambda s: s["name"] == name), F.lit(-1))["displayValue"]

    def points(same: bool) -> F.Column:
        match = F.filter("competitors", lambda c: (c["team"]["id"] == F.col("t.team.id")) == F.lit(same))
        return F.get(match, 0)["score"].try_cast("int")

    shots = {}
    for prefix, name in PAIRS.items():
        shots[f"{prefix}m"], shots[f"{prefix}a"] = made_attempted(stat(name))
    turnovers = F.when(stat("totalTurnovers") != "", stat("totalTurnovers"))
    rows = rows.select(
        "game_id",
        "document",
        provider_team_id(F.col("t.team.id")).alias("team_id"),
        (F.col("t.team.id") == F.col("home_code")).alias("is_home"),
        "minutes",
        points(True).alias("pts"),
        *[e.alias(n) for n, e in shots.items()],
        *[stat(name).try_cast("int").alias(column) for column, name in COUNTS.items()],
        F.coalesce(turnovers, stat("turnovers")).try_cast("int").alias("tov"),
        (points(True) - points(False)).alias("plus_minus"),
    )
    missing = F.lit(False)
    for name in [c for c in rows.columns if c not in ("game_id", "document")]:
        missing = missing | F.col(name).isNull()
    bad = rows.where(missing).select("game_id").distinct()
    rejects = bad.select("game_id", F.lit("incomplete box score").alias("reason"))
    return rows.join(bad, "game_id", "left_anti"), rejects


def _made() -> F.Column:
    return F.coalesce("p.scoringPlay", F.lit(False))


def _kind() -> F.Column:
    return F.regexp_replace(F.coalesce(F.col("p.type.text"), F.lit("")), "\n", " ")


def action_type() -> F.Column:
    """The common event vocabulary from the provider's play types; the first match wins."""
    kind = _kind()
    return (
        F.when(kind.startswith("Free Throw"), "Free Throw")
        .when(kind.contains("Rebound"), "Rebound")
        .when(kind.contains("Turnover"), "Turnover")
        .when(kind == "Jumpball", "Jump Ball")
        .when(kind.isin("End Period", "End Game", "Start Period"), "period")
        .when(kind == "Substitution", "Substitution")
        .when(kind.contains("Timeout"), "Timeout")
        .when(kind.contains("Review") | kind.contains("Challenge"), "Instant Replay")
        .when(F.coalesce("p.shootingPlay", F.lit(False)), F.when(_made(), "Made Shot").otherwise("Missed Shot"))
        .when(kind.contains("Foul"), "Foul")
    )


def parse_plays(summaries: DataFrame) -> DataFrame:
    """Plays as common events; `action_id` is the position in the feed, from 1."""
    docs = readable(summaries, "header").where("plays IS NOT NULL")
    rows = docs.select("game_id", "document", _home_code().alias("home_code"), F.posexplode("plays").alias("pos", "p"))
    kind, action = _kind(), action_type()
    detail = F.regexp_replace(F.regexp_extract(kind, "^Free Throw - (.*)", 1), "- ", "")
    sub_type = F.when(action == "Free Throw", F.trim(F.concat(F.lit("Free Throw "), detail))).when(
        action.isNull() | action.isin("Made Shot", "Missed Shot", "Foul"), kind
    )
    miss = F.when((action == "Free Throw") & ~_made(), "MISS")
    code = F.col("p.team.id")
    return rows.select(
        "game_id",
        "document",
        (F.col("pos") + 1).cast("long").alias("action_id"),
        F.coalesce(F.col("p.sequenceNumber").try_cast("long"), (F.col("pos") + 1).cast("long")).alias("action_number"),
        F.col("p.period.number").alias("period"),
        parse_display_clock(F.col("p.clock.displayValue")).alias("clock_seconds"),
        provider_team_id(code).alias("team_id"),
        F.when(code == F.col("home_code"), "h").when(code.isNotNull() & (code != ""), "v").alias("location"),
        F.lit(None).cast("long").alias("person_id"),
        action.alias("action_type"),
        sub_type.alias("sub_type"),
        F.coalesce(miss, F.col("p.text")).alias("description"),
        (F.coalesce("p.shootingPlay", F.lit(False)) & ~action.eqNullSafe("Free Throw")).alias("is_field_goal"),
        F.when(_made(), F.col("p.scoreValue")).alias("shot_value"),
        F.lit(None).cast("string").alias("shot_result"),
        F.col("p.homeScore").alias("score_home"),
        F.col("p.awayScore").alias("score_away"),
    )
