"""Feed parsers on small hand-made documents."""

import gzip
import json
from datetime import date

import pytest

from boutline.sources import board_feed, documents, stats_feed

LOG_HEADERS = [
    "SEASON_ID", "TEAM_ID", "TEAM_ABBREVIATION", "TEAM_NAME", "GAME_ID", "GAME_DATE", "MATCHUP", "WL", "MIN",
    "FGM", "FGA", "FG3M", "FG3A", "FTM", "FTA", "OREB", "DREB", "REB", "AST", "STL", "BLK", "TOV", "PF", "PTS", "PLUS_MINUS",
]


def log_row(game, team, matchup, pts, wl="W", minutes=240, reb=40):
    box = [30, 80, 10, 30, 10, 12, 8, 32, reb, 20, 5, 4, 12, 18]
    return ["22030", team, "X", "Team", game, "2030-11-02", matchup, wl, minutes, *box, pts, 1]


def write(tmp_path, name, doc):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(json.dumps(doc).encode()))
    else:
        path.write_text(doc if isinstance(doc, str) else json.dumps(doc))
    return str(tmp_path)


@pytest.fixture
def logs(spark, tmp_path):
    rows = [
        log_row("0023000001", 11, "AAA vs. BBB", 110),
        log_row("0023000001", 12, "BBB @ AAA", 100, "L"),
        log_row("0023000002", 13, "CCC @ DDD", 99),  # neutral site: both with "@"
        log_row("0023000002", 14, "DDD @ CCC", 98, "L"),
        log_row("0023000003", 11, "AAA vs. CCC", 0, None, 0),
        log_row("0023000003", 13, "CCC @ AAA", 0, None, 0),
        log_row("0023000004", 11, "AAA vs. DDD", 101),
        log_row("0023000004", 14, "DDD @ AAA", 91, "L", reb=None),
        log_row("0023000005", 12, "BBB vs. CCC", 90),
        log_row("0013000006", 11, "AAA vs. BBB", 110),  # preseason
        log_row("0013000006", 12, "BBB @ AAA", 100, "L"),
    ]
    path = write(tmp_path, "log.json.gz", {"resultSets": [{"headers": LOG_HEADERS, "rowSet": rows}]})
    return documents.read_documents(spark, path, stats_feed.GAME_LOG)


def test_game_logs_pair_and_reject(spark, logs):
    schedule = spark.createDataFrame([("0023000002", 14)], "game_id string, home_team_id long")
    games, stats, rejects = stats_feed.parse_game_logs(logs, schedule)
    got = {r["game_id"]: (r["home_team_id"], r["away_team_id"], r["home_score"], r["away_score"]) for r in games.collect()}
    assert got == {"0023000001": (11, 12, 110, 100), "0023000002": (14, 13, 98, 99)}
    row = games.where("game_id = '0023000001'").first()
    assert (row["season"], row["season_type"], row["game_date"], row["status"]) == (2030, "regular", date(2030, 11, 2), "final")
    assert stats.count() == 4
    assert {r["game_id"]: r["reason"] for r in rejects.collect()} == {
        "0023000003": "not played",
        "0023000004": "incomplete box score",
        "0023000005": "expected one home and one away row",
    }


def test_game_logs_without_schedule_reject_neutral_sites(logs):
    games, _, rejects = stats_feed.parse_game_logs(logs)
    assert [r["game_id"] for r in games.collect()] == ["0023000001"]
    assert "0023000002" in {r["game_id"] for r in rejects.collect()}


def test_schedule(spark, tmp_path):
    def game(gid, status, home, away, tip="2030-10-20T23:30:00Z"):
        return {
            "gameId": gid, "gameStatus": status, "gameDateEst": "2030-10-20T00:00:00Z", "gameDateTimeUTC": tip,
            "isNeutral": False, "homeTeam": {"teamId": home, "score": 90}, "awayTeam": {"teamId": away, "score": 80},
        }

    doc = {
        "leagueSchedule": {
            "seasonYear": "2030-31",
            "gameDates": [
                {"games": [game("0023000001", 3, 1, 2), game("0043000002", 1, 1, 2, "TBD"), game("0023000003", 7, 3, 4)]},
                {"games": [game("0013000004", 3, 1, 2), game("0053000005", 2, 0, 2)]},
            ],
        }
    }
    docs = documents.read_documents(spark, write(tmp_path, "s.json", doc), stats_feed.SCHEDULE)
    rows = {r["game_id"]: r for r in stats_feed.parse_schedule(docs).collect()}
    assert set(rows) == {"0023000001", "0043000002", "0023000003"}
    assert rows["0023000001"]["home_score"] == 90 and rows["0023000001"]["season"] == 2030
    assert rows["0043000002"]["tip_time_utc"] is None and rows["0043000002"]["home_score"] is None
    assert rows["0023000003"]["status"] == "scheduled" and rows["0043000002"]["season_type"] == "playoffs"


def action(i, **kw):
    base = dict(
        actionId=i, actionNumber=i * 10, clock="PT11M43.00S", period=1, teamId=0, personId=0, location="", actionType="",
        subType="", description="", isFieldGoal=0, shotValue=0, shotResult="", scoreHome="", scoreAway="",
    )
    return base | kw


def test_play_by_play(spark, tmp_path):
    actions = [
        action(1, actionType="period"),
        action(2, location="h", teamId=5, actionType="Made Shot", scoreHome="2", scoreAway="0", isFieldGoal=1, shotValue=2),
        action(4, clock="bad"),
        action(3, description="first"),
        action(5, scoreHome="2", scoreAway="3"),
        action(3, description="corrected"),
    ]
    path = write(tmp_path, "0023000001.json", {"game": {"gameId": "0023000001", "actions": actions}})
    docs = documents.read_documents(spark, path, stats_feed.PLAY_BY_PLAY)
    rows = {r["action_id"]: r for r in stats_feed.parse_play_by_play(docs).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    assert rows[1]["location"] is None and rows[1]["team_id"] is None and rows[1]["score_home"] == 0
    assert rows[2]["clock_seconds"] == 703.0 and rows[2]["is_field_goal"] and rows[2]["shot_value"] == 2
    assert rows[4]["clock_seconds"] == 0.0 and (rows[4]["score_home"], rows[4]["score_away"]) == (2, 0)
    # The repeated action keeps its last version, at the score of that later position.
    assert rows[3]["description"] == "corrected" and (rows[3]["score_home"], rows[3]["score_away"]) == (2, 3)


def test_malformed_documents_are_reported(spark, tmp_path):
    write(tmp_path, "a/good.json", {"game": {"gameId": "1", "actions": []}})
    write(tmp_path, "a/bad.json", "{not json")
    write(tmp_path, "a/empty.json", {"other": 1})
    docs = documents.read_documents(spark, str(tmp_path / "a"), stats_feed.PLAY_BY_PLAY)
    errors = {r["document"].split("/")[-1]: r["error"] for r in documents.rejected(docs, "game").collect()}
    assert errors == {"bad.json": "malformed JSON", "empty.json": "missing game"}


def event(eid, state="post", stype=2, home="2", away="18", name="STATUS_FINAL", abbr="STD", when="2031-01-02T01:30Z"):
    return {
        "id": eid,
        "date": when,
        "season": {"year": 2031, "type": stype},
        "status": {"type": {"name": name, "state": state}, "period": 4, "displayClock": "0.0"},
        "competitions": [
            {
                "type": {"abbreviation": abbr},
                "neutralSite": False,
                "competitors": [
                    {"homeAway": "away", "score": "99", "team": {"id": away}},
                    {"homeAway": "home", "score": "101", "team": {"id": home}},
                ],
            }
        ],
    }


def test_second_scoreboard(spark, tmp_path):
    events = [
        event("1"),
        event("2", state="pre"),
        event("3", stype=1),
        event("4", home="-1"),
        event("5", name="STATUS_POSTPONED"),
        event("6", abbr="CC"),
        event("7", state="odd", stype=5),
    ]
    docs = documents.read_documents(spark, write(tmp_path, "b.json", {"events": events}), board_feed.SCOREBOARD)
    rows = {r["provider_id"]: r for r in board_feed.parse_scoreboard(docs).collect()}
    assert set(rows) == {"1", "2", "7"}
    one = rows["1"]
    assert (one["season"], one["game_date"], one["home_score"], one["away_score"]) == (2030, date(2031, 1, 1), 101, 99)
    assert (one["home_team_id"], one["away_team_id"]) == (1610612738, 1610612752)
    assert rows["2"]["home_score"] is None and rows["7"]["status"] == "scheduled" and rows["7"]["season_type"] == "playin"


def summary():
    def team(tid, fg):
        pairs = {
            "fieldGoalsMade-fieldGoalsAttempted": fg,
            "threePointFieldGoalsMade-threePointFieldGoalsAttempted": "10-30",
            "freeThrowsMade-freeThrowsAttempted": "12-15",
            "offensiveRebounds": "8", "defensiveRebounds": "30", "totalRebounds": "38", "assists": "20", "steals": "7",
            "blocks": "3", "turnovers": "11", "totalTurnovers": "13" if tid == "2" else "", "fouls": "19",
        }
        return {"team": {"id": tid}, "statistics": [{"name": k, "displayValue": v} for k, v in pairs.items()]}

    def play(text, team=None, made=False, shooting=False, clock="11:35", period=1, desc="d", seq="5"):
        p = {
            "type": {"text": text}, "text": desc, "scoringPlay": made, "shootingPlay": shooting, "scoreValue": 2,
            "period": {"number": period}, "clock": {"displayValue": clock}, "homeScore": 2, "awayScore": 0, "sequenceNumber": seq,
        }
        return p | ({"team": {"id": team}} if team else {})

    competitors = [
        {"homeAway": "home", "score": "101", "team": {"id": "2"}},
        {"homeAway": "away", "score": "99", "team": {"id": "18"}},
    ]
    return {
        "header": {"competitions": [{"competitors": competitors}]},
        "boxscore": {"teams": [team("18", "40-85"), team("2", "38-80")]},
        "plays": [
            play("Jumpball"),
            play("Driving Layup\nShot", "2", True, True),
            play("Pullup Jump Shot", "18", False, True, "45.3"),
            play("Free Throw - 2 of 2", "18", False, True),
            play("Free Throw - - Technical", "2", True, True),
            play("Defensive Rebound", "2"),
            play("Bad Pass\nTurnover", "18"),
            play("Full Timeout"),
            play("Challenge"),
            play("Shooting Foul", "2"),
            play("End Period", period=5, clock="bad"),
            play("Ejection", seq=""),
        ],
    }


def test_second_box(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = documents.read_documents(spark, write(tmp_path, "g.json", summary()), board_feed.SUMMARY).withColumn("game_id", F.lit("g"))
    box, rejects = board_feed.parse_box(docs)
    rows = {r["is_home"]: r for r in box.collect()}
    assert rejects.count() == 0
    home, away = rows[True], rows[False]
    assert (home["minutes"], home["pts"], home["fgm"], home["fga"], home["tov"], home["plus_minus"]) == (265, 101, 38, 80, 13, 2)
    assert (away["tov"], away["plus_minus"], away["team_id"]) == (11, -2, 1610612752)


def test_second_plays(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = documents.read_documents(spark, write(tmp_path, "g.json", summary()), board_feed.SUMMARY).withColumn("game_id", F.lit("g"))
    rows = board_feed.parse_plays(docs).orderBy("action_id").collect()
    kinds = [(r["action_type"], r["sub_type"], r["description"]) for r in rows]
    assert kinds == [
        ("Jump Ball", None, "d"),
        ("Made Shot", "Driving Layup Shot", "d"),
        ("Missed Shot", "Pullup Jump Shot", "d"),
        ("Free Throw", "Free Throw 2 of 2", "MISS"),
        ("Free Throw", "Free Throw Technical", "d"),
        ("Rebound", None, "d"),
        ("Turnover", None, "d"),
        ("Timeout", None, "d"),
        ("Instant Replay", None, "d"),
        ("Foul", "Shooting Foul", "d"),
        ("period", None, "d"),
        (None, "Ejection", "d"),
    ]
    assert [r["action_id"] for r in rows] == list(range(1, 13)) and rows[11]["action_number"] == 12
    assert rows[0]["location"] is None and rows[1]["location"] == "h" and rows[2]["location"] == "v"
    assert rows[0]["clock_seconds"] == 695.0 and rows[2]["clock_seconds"] == 45.3 and rows[10]["clock_seconds"] == 0.0
    assert rows[1]["is_field_goal"] and not rows[3]["is_field_goal"] and rows[1]["shot_value"] == 2 and rows[2]["shot_value"] is None
