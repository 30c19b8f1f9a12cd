"""Nightly work follows the change: features of touched games, documents opened once, merges by file."""

import json
import os
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from boutline.plans.jobs import Deployment
from boutline.sources import documents
from boutline.sources.tables import Tables

GAME = (
    "game_id string, season int, season_type string, game_date date, home_team_id long, away_team_id long, "
    "status string, home_score int, away_score int, is_neutral boolean"
)
BOX = "game_id string, team_id long, pts int, minutes int, fgm int, fg3m int, fga int, fta int, ftm int, tov int, oreb int, dreb int, season int"
BASE = 1610612737


def make_league(seed=3, seasons=4, rounds=8, teams=6):
    """Games (a dict by id) and boxes of a small league in which seasons follow each other."""
    rng, games, boxes = np.random.default_rng(seed), {}, {}
    for s in range(seasons):
        for r in range(rounds):
            day = date(2010 + s, 11, 1) + timedelta(days=int(3 * r))
            order = rng.permutation(teams)
            for h, a in zip(order[::2], order[1::2]):
                gid = f"g{len(games):04d}"
                final = not (s == seasons - 1 and r >= rounds - 2)
                score = tuple(int(x) for x in rng.integers(80, 120, 2)) if final else (None, None)
                games[gid] = (gid, 2010 + s, "regular", day, BASE + int(h), BASE + int(a), "final" if final else "scheduled", *score, False)
                if final:
                    for t, pts in ((h, score[0]), (a, score[1])):
                        boxes[gid, int(t)] = (gid, BASE + int(t), pts, 240, *(int(rng.integers(lo, lo + 10)) for lo in (30, 8, 75, 15, 10, 8, 6, 28)), 2010 + s)
    return games, boxes


def store(at, spark, games, boxes):
    at.tables.replace("core.games", spark.createDataFrame(list(games.values()), GAME))
    at.tables.replace("core.team_game_stats", spark.createDataFrame(list(boxes.values()), BOX))


def features(at):
    rows = at.tables.read("features.game_features").collect()
    assert len({r["game_id"] for r in rows}) == len(rows)
    return {r["game_id"]: (r["season"], json.loads(r["features"])) for r in rows}


def same(got, want):
    assert got.keys() == want.keys()
    for key, (season, row) in want.items():
        assert got[key][0] == season
        for name, value in row.items():
            assert got[key][1][name] == (value if value is None else pytest.approx(value, abs=1e-9)), (key, name)


def written_seasons(at, commits):
    folder = at.tables._folder("features.game_features")
    new = at.tables._commits("features.game_features")[len(commits):]
    return {int(v[7:]) for n, k in new for v in os.listdir(at.tables._commit_folder("features.game_features", n, k)) if "=" in v} if folder else set()


def test_updated_features_equal_a_full_build(spark, tmp_path):
    games, boxes = make_league()
    at = Deployment(spark, str(tmp_path / "a"), str(tmp_path / "none"), clock=lambda: datetime(2014, 1, 1, 12))
    full = Deployment(spark, str(tmp_path / "b"), str(tmp_path / "none"), clock=lambda: datetime(2014, 1, 1, 12))
    store(at, spark, games, boxes)
    assert at.update_features() == len(games)
    version = at.tables.version("features.game_features")
    assert at.update_features() == 0 and at.tables.version("features.game_features") == version

    # A box score of the second season corrected, without a new result: that season from its day on and
    # the next season of both teams; no rating moves, so the other seasons are not written.
    key = next(k for k, b in boxes.items() if b[-1] == 2011 and k[0] > "g0030")
    boxes = {**boxes, key: (*boxes[key][:6], 99, *boxes[key][7:])}
    store(at, spark, games, boxes)
    commits = at.tables._commits("features.game_features")
    computed = at.update_features()
    game = games[key[0]]
    pair = {game[4], game[5]}
    hit = [g for g in games.values() if {g[4], g[5]} & pair and ((g[1] == 2011 and g[3] >= game[3]) or g[1] == 2012)]
    assert computed == len(hit) and written_seasons(at, commits) == {2011, 2012}
    store(full, spark, games, boxes)
    full.build_features()
    same(features(at), features(full))

    # In one night: a result comes in, a game goes, one moves to another day and one to another season,
    # and a new game is put on.
    ids = sorted(games)
    new = dict(games)
    last = next(g for g in games.values() if g[6] == "scheduled")
    new[last[0]] = (*last[:6], "final", 101, 99, False)
    del new[ids[40]]
    moved = games[ids[60]]
    new[ids[60]] = (*moved[:3], moved[3] + timedelta(days=1), *moved[4:])
    other = games[ids[26]]
    new[ids[26]] = (other[0], 2010, other[2], date(2010, 12, 30), *other[4:])
    new["zz"] = ("zz", 2013, "regular", date(2013, 12, 20), BASE, BASE + 1, "scheduled", None, None, True)
    left = {k: v for k, v in boxes.items() if k[0] in new}
    for d in (at, full):
        store(d, spark, new, left)
    at.update_features()
    full.build_features()
    same(features(at), features(full))
    # Seasons of a team that overlap: everything is built.
    wild = {**new, "g0000": (*new["g0000"][:3], date(2012, 11, 9), *new["g0000"][4:])}
    for d in (at, full):
        store(d, spark, wild, left)
    assert at.update_features() == len(wild)
    full.build_features()
    same(features(at), features(full))


def test_no_document_is_opened_twice(spark, tmp_path):
    landing = tmp_path / "landing"

    def put(path, doc, age):
        file = landing / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(doc)
        os.utime(file, (1_900_000_000 - age, 1_900_000_000 - age))

    put("pbp/season=2029/1.json", '{"game": {"gameId": "x"}}', 50)
    put("pbp/season=2029/2@old.json", "{", 40)
    put("board/day=20300101/a.json", "{}", 30)
    put("stray.json", "{}", 30)
    at = Deployment(spark, str(tmp_path / "root"), str(landing), clock=lambda: datetime(2030, 1, 1, 12))
    assert at.land() == 3
    stored = {r["subject"]: r for r in at.tables.read("raw.api_responses").collect()}
    assert set(stored) == {"x", "2", "a"} and stored["x"]["slot"] == "pbp-season-2029" and stored["a"]["bytes"] == 2
    version = at.tables.version("raw.api_responses")
    # Other content of the same time and size is not seen: nothing was opened, nothing written.
    put("pbp/season=2029/1.json", '{"game": {"gameId": "y"}}', 50)
    assert at.land() == 3 and at.tables.version("raw.api_responses") == version
    # A new version is one more document of the same request; one older than all others comes in too.
    put("pbp/season=2029/2@new.json", '{"game": {"gameId": "2"}}', 10)
    put("pbp/season=2029/3.json", "{}", 500)
    assert at.land() == 4
    rows = at.tables.read("raw.api_responses")
    assert rows.count() == 5 and {r["subject"] for r in rows.collect()} == {"x", "2", "3", "a"}
    # A document gone from the landing folder stays stored.
    (landing / "pbp/season=2029/3.json").unlink()
    assert at.land() == 4
    plan = documents.list_files(spark, [str(landing)])._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_a_night_without_news_reads_and_writes_no_season(spark, tmp_path):
    landing = tmp_path / "landing" / "schedule" / "season=2029"
    landing.mkdir(parents=True)
    sides = {"homeTeam": {"teamId": BASE, "score": 100}, "awayTeam": {"teamId": BASE + 1, "score": 90}}
    game = {"gameId": "0022900001", "gameStatus": 3, "gameDateEst": "2029-11-01T00:00:00Z", "gameDateTimeUTC": "", "isNeutral": False, **sides}
    doc = {"leagueSchedule": {"seasonYear": "2029-30", "gameDates": [{"games": [game]}]}}
    (landing / "a.json").write_text(json.dumps(doc))
    events = tmp_path / "landing" / "pbp" / "season=2029"
    events.mkdir(parents=True)
    (events / "0022900001.json").write_text("{")
    at = Deployment(spark, str(tmp_path / "root"), str(tmp_path / "landing"), clock=lambda: datetime(2030, 1, 1, 12))
    today = date(2030, 1, 1)
    run = lambda **kw: {r["task_key"]: r["status"] for r in at.ingest_seasons(2029, 2029, today, **kw).collect()}
    first = run()
    assert first == {"schedule:2029": "success", "pbp:0022900001": "failed"}
    names = ("raw.api_responses", "raw.loaded_documents", "core.games", "core.pbp_events", "raw.rejects")
    versions = [at.tables.version(n) for n in names]
    assert run() == first and [at.tables.version(n) for n in names] == versions
    assert {r["attempts"] for r in at.tables.read("raw.ingestion_runs").collect()} == {2}
    # The game's events come in whole; then a forced run loads all again.
    (events / "0022900001@2.json").write_text(json.dumps({"game": {"gameId": "0022900001", "actions": []}}))
    assert run() == {"schedule:2029": "success", "pbp:0022900001": "success"}
    assert run() == {"schedule:2029": "success"}
    assert run(force=True) == {"schedule:2029": "success", "pbp:0022900001": "success"}


def test_a_merge_rewrites_only_files_that_hold_a_key(spark, tmp_path):
    tables, name = Tables(spark, str(tmp_path)), "core.pbp_events"
    tables.small_partition = 0
    make = lambda rows: spark.createDataFrame(rows, "game_id string, action_id long, description string, season int")
    want = {}

    def merge(rows):
        want.update({(g, a, s): d for g, a, d, s in rows})
        tables.upsert(name, make(rows))
        assert {(r["game_id"], r["action_id"], r["season"]): r["description"] for r in tables.read(name).collect()} == want
        assert tables.read(name).count() == len(want)

    def files():
        out = set()
        for path in tables._current_paths(name):
            out |= {path} if path.endswith(".parquet") else {f"{path}/{f}" for f in os.listdir(path) if f.endswith(".parquet")}
        return out

    for day in range(5):  # a day's games a night, in two seasons
        merge([(f"g{day}{i}", a, "new", 2000 + i) for i in range(2) for a in range(50)])
    merge([(f"g9{i}", 1, None, 2000) for i in range(3)])
    before = files()
    merge([("g21", 7, "corrected", 2001), ("g21", 99, "late", 2001), ("h", 1, "other", 2002)])
    gone = before - files()
    assert gone and all("season=2001" in f for f in gone) and len(gone) < sum("season=2001" in f for f in before)
    # Rows of new keys alone replace no file; the same rows again change nothing.
    before = files()
    merge([("k", 1, "x", 2000)])
    assert before < files()
    merge([("k", 1, "x", 2000)])
    # A reader that has planned before goes on reading its version until a vacuum.
    old = tables.read(name)
    n = old.count()
    merge([("g00", 3, "again", 2000)])
    assert old.count() == n
    tables.vacuum(name)
    assert tables.read(name).count() == len(want)
    merge([("g00", 3, "after vacuum", 2000), ("g33", 1, "z", 2001)])
    assert tables.compact_partitions(name, 3) == ["season=2000", "season=2001"]
    merge([("g00", 4, "after compaction", 2000)])
    tables.vacuum(name)
    merge([("g00", 5, "end", 2000)])
    tables.replace(name, tables.read(name))
    tables.vacuum(name)
    assert not [e for e in os.listdir(tables._folder(name)) if e.startswith("removed-")]
    merge([("g00", 6, "after all", 2000)])


def test_a_merge_that_did_not_end_is_not_seen(spark, tmp_path):
    tables, name = Tables(spark, str(tmp_path)), "core.games"
    tables.small_partition = 0
    rows = lambda status: spark.createDataFrame([("a", status, 2000), ("b", status, 2001)], "game_id string, status string, season int")
    tables.upsert(name, rows("scheduled"))
    number = tables.version(name) + 1
    listed = [p[len(tables._folder(name)) + 1 :] for p in tables._current_paths(name)]
    with open(tables._removed_list(name, number), "w") as out:
        out.write("\n".join(listed))
    os.makedirs(tables._commit_folder(name, number, "merge") + "/season=2000")
    assert tables.read(name).count() == 2
    tables.upsert(name, rows("final"))
    assert {r["status"] for r in tables.read(name).collect()} == {"final"} and tables.read(name).count() == 2
    tables.vacuum(name)
    assert tables.read(name).count() == 2


def test_a_release_shows_all_tables_of_one_time(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    make = lambda n: spark.createDataFrame([("a", n, 2000)], "game_id string, home_score int, season int")
    ratings = lambda n: spark.createDataFrame([("a", 1, float(n), 2000)], "game_id string, team_id long, elo_pre double, season int")

    def seen():
        at = tables.released()
        return at.read("core.games").first()["home_score"], at.read("features.elo_ratings").first()["elo_pre"]

    tables.replace("core.games", make(1))
    tables.replace("features.elo_ratings", ratings(1))
    assert seen() == (1, 1.0) and tables.make_release() == 1
    reader = tables.released()
    # Half of the next version is there: readers of the release see none of it, and a vacuum leaves them theirs.
    tables.upsert("core.games", make(2))
    tables.vacuum("core.games")
    assert seen() == (1, 1.0) and tables.read("core.games").first()["home_score"] == 2
    tables.replace("features.elo_ratings", ratings(2))
    assert seen() == (1, 1.0) and tables.make_release() == 2
    assert seen() == (2, 2.0) and reader.read("core.games").first()["home_score"] == 1
    with pytest.raises(RuntimeError, match="cannot be written"):
        reader.append("core.games", make(3))
    for name in ("core.games", "features.elo_ratings"):
        tables.vacuum(name)
    assert seen() == (2, 2.0)
    # A release of which only the pending file is there does not count.
    (tmp_path / "releases" / "pending-00000003").write_text("{")
    assert seen() == (2, 2.0) and tables.make_release() == 3
