"""First provider: game logs, schedule, play-by-play."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.functions.calendar import numeric_status, parse_season, parse_utc, score_if_started, season_type_of
from boutline.functions.clock import parse_iso_clock
from boutline.operators.latest import latest_by
from boutline.operators.states import forward_fill_scores
from boutline.sources.documents import ARRIVAL, newest_documents, readable

GAME_LOG = "resultSets array<struct<headers: array<string>, rowSet: array<array<string>>>>"
SCHEDULE = (
    "leagueSchedule struct<seasonYear: string, gameDates: array<struct<games: array<struct<"
    "gameId: string, gameStatus: int, gameDateEst: string, gameDateTimeUTC: string, isNeutral: boolean, "
    "homeTeam: struct<teamId: long, score: int>, awayTeam: struct<teamId: long, score: int>>>>>>"
)
PLAY_BY_PLAY = (
    "game struct<gameId: string, actions: array<struct<actionId: long, actionNumber: long, clock: string, "
    "period: int, teamId: long, personId: long, location: string, actionType: string, subType: string, "
    "description: string, isFieldGoal: int, shotValue: int, shotResult: string, scoreHome: string, scoreAway: string>>>"
)
SCOREBOARD = (
    "scoreboard struct<games: array<struct<gameId: string, gameStatus: int, period: int, gameTimeUTC: string, "
    "homeTeam: struct<score: int>, awayTeam: struct<score: int>>>>"
)

# Box columns and the feed's names for them (fixed values).
BOX = {
    "minutes": "MIN", "pts": "PTS", "fgm": "FGM", "fga": "FGA", "fg3m": "FG3M", "fg3a": "FG3A",
    "ftm": "FTM", "fta": "FTA", "oreb": "OREB", "dreb": "DREB", "reb": "REB", "ast": "AST",
    "stl": "STL", "blk": "BLK", "tov": "TOV", "pf": "PF", "plus_minus": "PLUS_MINUS",
}


def _log_rows(docs: DataFrame) -> DataFrame:
    """Game-log rows as typed columns; the header row names each position."""
    first = F.col("resultSets")[0]
    rows = readable(docs, "resultSets").select(
        *ARRIVAL, first["headers"].alias("headers"), F.explode(first["rowSet"]).alias("row")
    )
    rows = rows.where(F.size("headers") == F.size("row"))

    def cell(name: str) -> F.Column:
        return F.get(F.col("row"), (F.array_position("headers", name) - 1).cast("int"))

    typed = rows.select(
        *ARRIVAL,
        cell("GAME_ID").alias("game_id"),
        cell("TEAM_ID").try_cast("long").alias("team_id"),
        cell("SEASON_ID").alias("season_id"),
        cell("GAME_DATE").alias("date_text"),
        cell("MATCHUP").alias("matchup"),
        cell("WL").alias("wl"),
        *[cell(feed).try_cast("double").cast("int").alias(name) for name, feed in BOX.items()],
    )
    # A repeated line of one document stays a fault of it; a log landed again replaces its games.
    newest = typed.groupBy("game_id").agg(F.max(F.struct(*ARRIVAL)).alias("m")).select("game_id", F.col("m.document").alias("document"))
    return typed.join(newest, ["game_id", "document"], "left_semi").drop("fetched")


def parse_game_logs(docs: DataFrame, schedule: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(games, team box rows, rejects) of landed game logs.

    The log has one row per team: 'A vs. B' at home, 'B @ A' away. Neutral-site games show '@'
    twice; `schedule` (game_id, home_team_id) names their designated home team."""
    rows = _log_rows(docs).where(season_type_of(F.col("game_id")).isNotNull())
    if schedule is None:
        rows = rows.withColumn("designated", F.lit(None).cast("long"))
    else:
        rows = rows.join(
            schedule.select("game_id", F.col("home_team_id").alias("designated")), "game_id", "left"
        )
    by_text = F.col("matchup").contains(" vs. ")
    by_id = F.coalesce(F.col("team_id") == F.col("designated"), F.lit(False))
    missing = F.lit(False)
    for name in BOX:
        missing = missing | F.col(name).isNull()
    judged = rows.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(by_text).alias("homes"),
        F.count_if(F.col("matchup").contains(" @ ")).alias("aways"),
        F.count_if(by_id).alias("named"),
        F.max("designated").alias("__designated"),
        F.bool_or(F.col("wl").isNull() | (F.coalesce("minutes", F.lit(0)) == 0)).alias("unplayed"),
        F.bool_or(missing).alias("incomplete"),
    )
    text_ok = (F.col("homes") == 1) & (F.col("aways") == 1)
    use_id = (F.col("n") == 2) & ~text_ok & F.col("__designated").isNotNull()
    paired = (F.col("n") == 2) & (text_ok | (use_id & (F.col("named") == 1)))
    judged = judged.select(
        "game_id",
        use_id.alias("use_id"),
        F.when(~paired, "expected one home and one away row")
        .when(F.col("unplayed"), "not played")
        .when(F.col("incomplete"), "incomplete box score")
        .alias("reason"),
    )
    rejects = judged.where("reason IS NOT NULL").select("game_id", "reason")
    good = rows.join(judged.where("reason IS NULL"), "game_id")
    good = good.withColumn("is_home", F.when(F.col("use_id"), by_id).otherwise(by_text))
    stats = good.select("game_id", "team_id", "is_home", *BOX)

    def side(home: bool, column: str) -> F.Column:
        return F.max(F.when(F.col("is_home") == home, F.col(column)))

    games = good.groupBy("game_id").agg(
        side(True, "season_id").alias("season_id"),
        side(True, "date_text").alias("date_text"),
        side(True, "team_id").alias("home_team_id"),
        side(False, "team_id").alias("away_team_id"),
        side(True, "pts").alias("home_score"),
        side(False, "pts").alias("away_score"),
    )
    games = games.select(
        "game_id",
        F.substring("season_id", 2, 10).try_cast("int").alias("season"),
        season_type_of(F.col("game_id")).alias("season_type"),
        F.substring("date_text", 1, 10).try_cast("date").alias("game_date"),
        "home_team_id",
        "away_team_id",
        F.lit("final").alias("status"),
        "home_score",
        "away_score",
    )
    return games, stats, rejects


def parse_schedule(docs: DataFrame) -> DataFrame:
    """Games of the season's schedule; other game types and unresolved slots are dropped. A
    game in several landed schedules is as the newest has it."""
    days = readable(docs, "leagueSchedule").select(
        *ARRIVAL,
        parse_season(F.col("leagueSchedule.seasonYear")).alias("season"),
        F.explode("leagueSchedule.gameDates").alias("day"),
    )
    g = days.select(*ARRIVAL, "season", F.explode("day.games").alias("g"))
    home, away = F.coalesce("g.homeTeam.teamId", F.lit(0)), F.coalesce("g.awayTeam.teamId", F.lit(0))
    status = numeric_status(F.col("g.gameStatus"))
    rows = g.where(season_type_of(F.col("g.gameId")).isNotNull() & (home != 0) & (away != 0)).select(
        *ARRIVAL,
        F.col("g.gameId").alias("game_id"),
        "season",
        season_type_of(F.col("g.gameId")).alias("season_type"),
        F.substring("g.gameDateEst", 1, 10).try_cast("date").alias("game_date"),
        parse_utc(F.col("g.gameDateTimeUTC")).alias("tip_time_utc"),
        home.alias("home_team_id"),
        away.alias("away_team_id"),
        status.alias("status"),
        score_if_started(status, F.col("g.homeTeam.score")).alias("home_score"),
        score_if_started(status, F.col("g.awayTeam.score")).alias("away_score"),
        F.coalesce("g.isNeutral", F.lit(False)).alias("is_neutral"),
    )
    return latest_by(rows, ["game_id"], ARRIVAL).drop(*ARRIVAL)


def _or_null(column: str) -> F.Column:
    """Empty strings and zeros mean "no value" in this feed."""
    c = F.col(column)
    return F.when((c != "") if column in TEXT else (c != 0), c)


TEXT = {"a.location", "a.actionType", "a.subType", "a.description", "a.shotResult"}


def parse_play_by_play(docs: DataFrame) -> DataFrame:
    """Events in feed order: scores carried forward, a repeated action keeps its last version. Of
    several documents of a game the newest is read."""
    rows = newest_documents(readable(docs, "game"), F.col("game.gameId")).select(F.col("game.gameId").alias("game_id"), F.posexplode("game.actions").alias("pos", "a"))
    flat = rows.select(
        "game_id",
        "pos",
        F.col("a.actionId").alias("action_id"),
        F.col("a.actionNumber").alias("action_number"),
        F.col("a.period").alias("period"),
        parse_iso_clock(F.col("a.clock")).alias("clock_seconds"),
        _or_null("a.teamId").alias("team_id"),
        _or_null("a.location").alias("location"),
        _or_null("a.personId").alias("person_id"),
        _or_null("a.actionType").alias("action_type"),
        _or_null("a.subType").alias("sub_type"),
        _or_null("a.description").alias("description"),
        (F.coalesce("a.isFieldGoal", F.lit(0)) != 0).alias("is_field_goal"),
        _or_null("a.shotValue").alias("shot_value"),
        _or_null("a.shotResult").alias("shot_result"),
        F.col("a.scoreHome").alias("raw_score_home"),
        F.col("a.scoreAway").alias("raw_score_away"),
    )
    filled = forward_fill_scores(flat).drop("raw_score_home", "raw_score_away")
    return latest_by(filled, ["game_id", "action_id"], ["pos"]).drop("pos")


def parse_scoreboard(docs: DataFrame) -> DataFrame:
    """Live status of a day's games."""
    g = readable(docs, "scoreboard").select("fetched", F.explode("scoreboard.games").alias("g"))
    return g.select(
        F.unix_micros("fetched").alias("arrival"),
        F.col("g.gameId").alias("game_id"),
        numeric_status(F.col("g.gameStatus")).alias("status"),
        F.coalesce("g.period", F.lit(0)).alias("period"),
        F.coalesce("g.homeTeam.score", F.lit(0)).alias("home_score"),
        F.coalesce("g.awayTeam.score", F.lit(0)).alias("away_score"),
        parse_utc(F.col("g.gameTimeUTC")).alias("tip_time_utc"),
    )
