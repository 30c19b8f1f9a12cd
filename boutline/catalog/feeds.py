"""Feed parsers over documents that Spark writes from the tables (S1, S2, S4, S5, P11, P12): one
small document per game, so the landing folder grows with the league."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.catalog.base import query
from boutline.fixtures import League
from boutline.functions.calendar import lookup
from boutline.operators.features import tasks_of
from boutline.operators.latest import latest_by
from boutline.session import dealt, fresh_path
from boutline.sources import board_feed, dimensions, documents, stats_feed

BASE_ID = 1610612737  # team 0 of the league under the first provider's numbering
FILE_DOCUMENTS = 20_000


def _landed(L: League, name: str, rows: DataFrame, schema: str) -> DataFrame:
    """Write one JSON document per row and read them back the way a landing folder is read. A gzip
    file is read by one task, so none holds more than `FILE_DOCUMENTS`."""
    path = fresh_path(L.spark, f"landing/{name}")
    landed = rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite")
    landed.option("compression", "gzip").option("maxRecordsPerFile", FILE_DOCUMENTS).text(path)
    return documents.read_documents(L.spark, path, schema, per_line=True)


def _log_documents(L: League) -> DataFrame:
    """Game logs: most games paired by their matchup text; every 11th is at a neutral site, every
    13th was not played, every 17th lacks a statistic, every 19th lacks a row."""
    ok = F.col("ok")
    games = L.games().select("game_id", "ok", "season", "game_date", "home_team_id")
    rows = L.stats().join(games, "game_id").where((ok % 19 != 0) | F.col("is_home"))
    versus = F.when(F.col("is_home") & (ok % 11 != 0), "A vs. B").otherwise("B @ A")
    box = {
        "MIN": F.when(ok % 13 == 0, 0).otherwise(F.col("minutes")),
        **{c.upper(): F.col(c) for c in ("pts", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "oreb", "dreb", "tov", "plus_minus")},
        "REB": F.when((ok % 17 != 0) | F.col("is_home"), F.col("oreb") + F.col("dreb")),
        **{c: F.lit(7) for c in ("AST", "STL", "BLK", "PF")},
    }
    cells = {
        "SEASON_ID": F.concat(F.lit("2"), F.col("season").cast("string")),
        "TEAM_ID": F.col("team_id"),
        "GAME_ID": F.concat(F.lit("002"), F.substring("game_id", 4, 7)),
        "GAME_DATE": F.col("game_date"),
        "MATCHUP": versus,
        "WL": F.when(F.col("plus_minus") > 0, "W").otherwise("L"),
        **box,
    }
    row = F.array(*[c.cast("string") for c in cells.values()])
    # Two rows per game at most.
    packed = rows.groupBy("game_id").agg(F.collect_list(row).alias("rowSet"))
    headers = F.array(*[F.lit(h) for h in cells])
    return packed.select(F.array(F.struct(headers.alias("headers"), F.col("rowSet").alias("rowSet"))).alias("resultSets"))


_LOGGED = """(SELECT s.*, g.ok, g.season, g.game_date, g.home_team_id, g.away_team_id, '002' || substr(s.game_id, 4, 7) AS gid FROM stats s JOIN games g USING (game_id))"""
_GOOD = "ok % 19 <> 0 AND ok % 13 <> 0 AND ok % 17 <> 0"


def _parsed(L: League, name: str):
    docs = _landed(L, name, _log_documents(L), stats_feed.GAME_LOG)
    schedule = L.games().select(F.concat(F.lit("002"), F.substring("game_id", 4, 7)).alias("game_id"), "home_team_id")
    return stats_feed.parse_game_logs(docs, schedule)


@query(
    "s1_game_log_games",
    f"""SELECT gid AS game_id, season, 'regular' AS season_type, game_date, home_team_id, away_team_id, max(pts) FILTER (WHERE is_home) AS home_score, max(pts) FILTER (WHERE NOT is_home) AS away_score
        FROM {_LOGGED} WHERE {_GOOD} GROUP BY ALL""",
)
def s1_game_log_games(L: League) -> DataFrame:
    return _parsed(L, "s1-games")[0].drop("status")


@query(
    "s1_game_log_box",
    f"SELECT gid AS game_id, team_id, is_home, minutes, pts, fga, oreb + dreb AS reb, plus_minus FROM {_LOGGED} WHERE {_GOOD}",
)
def s1_game_log_box(L: League) -> DataFrame:
    return _parsed(L, "s1-box")[1].select("game_id", "team_id", "is_home", "minutes", "pts", "fga", "reb", "plus_minus")


@query(
    "p12_rejected_games",
    f"""SELECT DISTINCT gid AS game_id, CASE WHEN ok % 19 = 0 THEN 'expected one home and one away row' WHEN ok % 13 = 0 THEN 'not played' ELSE 'incomplete box score' END AS reason
        FROM {_LOGGED} WHERE NOT ({_GOOD})""",
)
def p12_rejected_games(L: League) -> DataFrame:
    return _parsed(L, "p12")[2]


@query(
    "p11_neutral_home",
    f"SELECT gid AS game_id, team_id AS home_team_id FROM {_LOGGED} WHERE {_GOOD} AND ok % 11 = 0 AND is_home",
)
def p11_neutral_home(L: League) -> DataFrame:
    """Games whose text names no home team, resolved by the schedule."""
    games = _parsed(L, "p11")[0].select("game_id", "home_team_id")
    return games.where(F.substring("game_id", 4, 7).cast("long") % 11 == 0)


@query(
    "s2_schedule",
    """SELECT '00' || kind || substr(game_id, 4, 7) AS game_id, season, CASE kind WHEN 2 THEN 'regular' WHEN 4 THEN 'playoffs' ELSE 'playin' END AS season_type, game_date,
       CAST(epoch(tip_time_utc) AS BIGINT) AS tip, home_team_id + 1 AS home_team_id, away_team_id + 1 AS away_team_id, status, home_score, away_score, coalesce(is_neutral, false) AS is_neutral
       FROM (SELECT *, CASE WHEN ok % 9 < 6 THEN 2 WHEN ok % 9 = 6 THEN 4 WHEN ok % 9 = 7 THEN 5 ELSE 1 END AS kind FROM games) WHERE kind <> 1 AND ok % 31 <> 0""",
)
def s2_schedule(L: League) -> DataFrame:
    ok = F.col("ok")
    kind = F.when(ok % 9 < 6, "002").when(ok % 9 == 6, "004").when(ok % 9 == 7, "005").otherwise("001")

    def side(s: str) -> F.Column:
        # Every 31st game is an open slot: no away team yet.
        team = F.col(f"{s}_team_id") + 1
        if s == "away":
            team = F.when(ok % 31 == 0, 0).otherwise(team)
        return F.struct(team.alias("teamId"), F.coalesce(f"{s}_score", F.lit(0)).alias("score"))

    game = F.struct(
        F.concat(kind, F.substring("game_id", 4, 7)).alias("gameId"),
        F.when(F.col("status") == "final", 3).when(F.col("status") == "live", 2).otherwise(1).alias("gameStatus"),
        F.concat(F.col("game_date").cast("string"), F.lit("T00:00:00Z")).alias("gameDateEst"),
        F.coalesce(F.date_format("tip_time_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("TBD")).alias("gameDateTimeUTC"),
        F.col("is_neutral").alias("isNeutral"),
        side("home").alias("homeTeam"),
        side("away").alias("awayTeam"),
    )
    label = F.format_string("%d-%02d", F.col("season"), (F.col("season") + 1) % 100)
    document = F.struct(label.alias("seasonYear"), F.array(F.struct(F.array(game).alias("games"))).alias("gameDates"))
    docs = _landed(L, "s2", L.games().select(document.alias("leagueSchedule")), stats_feed.SCHEDULE)
    parsed = stats_feed.parse_schedule(docs)
    return parsed.withColumn("tip", F.unix_seconds("tip_time_utc")).drop("tip_time_utc")


def _code(place: F.Column) -> F.Column:
    """A code of the second provider, from the static dimension, by its place there."""
    codes = [row[6] for row in dimensions.TEAMS]
    return F.get(F.array(*[F.lit(c) for c in codes]), place.cast("int"))


# The provider knows thirty teams: each team plays under the place of its id, the away team under
# the next one where both have the same.
_HOME_PLACE = "home_team_id % 30"
_AWAY_PLACE = "(away_team_id + CASE WHEN away_team_id % 30 = home_team_id % 30 THEN 1 ELSE 0 END) % 30"


def _competitors() -> F.Column:
    return F.array(
        *[
            F.struct(
                F.lit(s).alias("homeAway"),
                F.coalesce(F.col(f"{s}_score"), F.lit(0)).cast("string").alias("score"),
                F.struct(_code(F.expr(place)).alias("id")).alias("team"),
            )
            for s, place in (("away", _AWAY_PLACE), ("home", _HOME_PLACE))
        ]
    )


@query(
    "s4_scoreboard",
    f"""SELECT 'b' || ok AS provider_id, season, CASE ok % 4 WHEN 3 THEN 'playoffs' ELSE 'regular' END AS season_type, game_date, CAST(epoch(tip_time_utc) AS BIGINT) AS tip,
        {_HOME_PLACE} + {BASE_ID} AS home_team_id, {_AWAY_PLACE} + {BASE_ID} AS away_team_id, status, home_score, away_score
        FROM games WHERE tip_time_utc IS NOT NULL AND ok % 4 <> 1 AND ok % 23 <> 0 AND ok % 29 <> 0""",
)
def s4_scoreboard(L: League) -> DataFrame:
    """Every fourth event is preseason, every 23rd postponed, every 29th an exhibition."""
    ok = F.col("ok")
    games = L.games().where("tip_time_utc IS NOT NULL")
    state = F.when(F.col("status") == "final", "post").when(F.col("status") == "live", "in").otherwise("pre")
    event = F.struct(
        F.concat(F.lit("b"), ok.cast("string")).alias("id"),
        F.date_format("tip_time_utc", "yyyy-MM-dd'T'HH:mm'Z'").alias("date"),
        F.struct((F.col("season") + 1).alias("year"), F.when(ok % 4 == 3, 3).when(ok % 4 == 1, 1).otherwise(2).alias("type")).alias("season"),
        F.struct(
            F.struct(F.when(ok % 23 == 0, "STATUS_POSTPONED").otherwise("STATUS_OK").alias("name"), state.alias("state")).alias("type")
        ).alias("status"),
        F.array(
            F.struct(F.struct(F.when(ok % 29 == 0, "CC").otherwise("STD").alias("abbreviation")).alias("type"), _competitors().alias("competitors"))
        ).alias("competitions"),
    )
    docs = _landed(L, "s4", games.select(F.array(event).alias("events")), board_feed.SCOREBOARD)
    parsed = board_feed.parse_scoreboard(docs)
    return parsed.select(
        "provider_id", "season", "season_type", "game_date", F.unix_seconds("tip_time_utc").alias("tip"),
        "home_team_id", "away_team_id", "status", "home_score", "away_score",
    )


@query(
    "s5_summary_box",
    f"""SELECT s.game_id, CASE WHEN is_home THEN {_HOME_PLACE} ELSE {_AWAY_PLACE} END + {BASE_ID} AS team_id, is_home, CASE WHEN g.ok % 16 = 0 THEN 265 ELSE 240 END AS minutes, pts, fgm, fga, fg3m, ftm, oreb, tov,
        CASE WHEN is_home THEN home_score - away_score ELSE away_score - home_score END AS plus_minus FROM stats s JOIN games g USING (game_id) WHERE g.status = 'final' AND g.ok % 37 <> 0""",
)
def s5_summary_box(L: League) -> DataFrame:
    """Every 37th summary lacks a statistic and is rejected as a whole."""
    ok = F.col("ok")
    tasks = tasks_of(L.games())
    final = dealt(L.games().where("status = 'final'").select("game_id", "ok", "home_team_id", "away_team_id", "home_score", "away_score"), tasks, "game_id")
    lines = dealt(L.stats().select("game_id", "is_home", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "oreb", "tov"), tasks, "game_id")
    stats = lines.join(final.select("game_id", "ok", F.expr(_HOME_PLACE).alias("home_place"), F.expr(_AWAY_PLACE).alias("away_place")), "game_id")

    def team(t: F.Column) -> F.Column:
        def pair(made: str, attempted: str) -> F.Column:
            return F.concat_ws("-", t[made], t[attempted])

        values = {
            board_feed.PAIRS["fg"]: pair("fgm", "fga"),
            board_feed.PAIRS["fg3"]: pair("fg3m", "fg3a"),
            board_feed.PAIRS["ft"]: pair("ftm", "fta"),
            **{name: F.lit("7") for name in board_feed.COUNTS.values()},
            "offensiveRebounds": F.when((t["ok"] % 37 != 0) | t["is_home"], t["oreb"].cast("string")).otherwise("-"),
            "turnovers": F.lit("3"),
            "totalTurnovers": t["tov"].cast("string"),
        }
        listed = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("displayValue")) for n, v in values.items()])
        place = F.when(t["is_home"], t["home_place"]).otherwise(t["away_place"])
        return F.struct(F.struct(_code(place).alias("id")).alias("team"), listed.alias("statistics"))

    # Two teams per summary. Numbers are gathered and sorted; a summary's text is made as it is written.
    packed = stats.groupBy("game_id").agg(F.collect_list(F.struct(*[c for c in stats.columns if c != "game_id"])).alias("lines"))
    play = F.struct(F.struct(F.when(ok % 16 == 0, 5).otherwise(4).alias("number")).alias("period"))
    rows = final.join(packed, "game_id").select(
        "game_id",
        F.struct(F.array(F.struct(_competitors().alias("competitors"))).alias("competitions")).alias("header"),
        F.struct(F.transform("lines", team).alias("teams")).alias("boxscore"),
        F.array(play).alias("plays"),
    )
    docs = _landed(L, "s5", rows, f"game_id string, {board_feed.SUMMARY}")
    box, _ = board_feed.parse_box(docs)
    return box.select("game_id", "team_id", "is_home", "minutes", "pts", "fgm", "fga", "fg3m", "ftm", "oreb", "tov", "plus_minus")


@query(
    "s3_repeated_actions",
    "SELECT game_id, action_id, action_type, CASE WHEN k % 7 = 0 THEN 'corrected' ELSE description END AS description, score_home, score_away FROM pbp",
)
def s3_repeated_actions(L: League) -> DataFrame:
    """Feed rows where every seventh action comes twice: the later version stays."""
    events = L.events()
    first = events.select("game_id", "action_id", "action_type", "description", "score_home", "score_away", F.lit(0).alias("pos"))
    again = events.where("k % 7 = 0").select(
        "game_id", "action_id", "action_type", F.lit("corrected").alias("description"), "score_home", "score_away", F.lit(1).alias("pos")
    )
    return latest_by(first.unionByName(again), ["game_id", "action_id"], ["pos"]).drop("pos")


# The provider's names for the common kinds of play.
_PLAY_TEXT = {
    "Made Shot": "Jump Shot",
    "Missed Shot": "Jump Shot",
    "Rebound": "Defensive Rebound",
    "Turnover": "Lost Ball Turnover",
    "Free Throw": "Free Throw - 1 of 2",
    "Jump Ball": "Jumpball",
    "Substitution": "Substitution",
    "Timeout": "Full Timeout",
    "period": "End Period",
    "Foul": "Shooting Foul",
}


@query(
    "s6_plays",
    """SELECT game_id, row_number() OVER (PARTITION BY game_id ORDER BY action_id) AS action_id, action_type, location, period,
        floor(clock_seconds)::DOUBLE AS clock_seconds, score_home, score_away FROM pbp""",
    "clock_seconds",
)
def s6_plays(L: League) -> DataFrame:
    """Every event as a play of a summary of its game."""
    kind = F.col("action_type")
    home, away = _code(F.lit(0)), _code(F.lit(1))
    seconds = F.floor("clock_seconds").cast("int")
    play = F.struct(
        "action_id",
        F.struct(F.coalesce(lookup(kind, _PLAY_TEXT), F.lit("Unknown")).alias("text")).alias("type"),
        F.col("description").alias("text"),
        F.coalesce(kind == "Made Shot", F.lit(False)).alias("scoringPlay"),
        F.coalesce(kind.isin("Made Shot", "Missed Shot"), F.lit(False)).alias("shootingPlay"),
        F.struct(F.when(F.col("location") == "h", home).when(F.col("location") == "v", away).alias("id")).alias("team"),
        F.struct(F.col("period").alias("number")).alias("period"),
        F.struct(F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), seconds % 60).alias("displayValue")).alias("clock"),
        F.col("score_home").alias("homeScore"),
        F.col("score_away").alias("awayScore"),
    )
    sides = [F.struct(F.lit(s).alias("homeAway"), F.struct(c.alias("id")).alias("team")) for s, c in (("home", home), ("away", away))]
    # One game's plays, as the provider sends them.
    rows = L.events().groupBy("game_id").agg(F.array_sort(F.collect_list(play)).alias("plays"))
    rows = rows.withColumn("header", F.struct(F.array(F.struct(F.array(*sides).alias("competitors"))).alias("competitions")))
    docs = _landed(L, "s6", rows, f"game_id string, {board_feed.SUMMARY}")
    parsed = board_feed.parse_plays(docs)
    return parsed.select("game_id", "action_id", "action_type", "location", "period", "clock_seconds", "score_home", "score_away")
