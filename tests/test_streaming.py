"""The live path: what is emitted when, across polls, restarts, model changes and board updates."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from boutline.streaming import live
from boutline.streaming.live import FEED, LiveJob, ModelPointer


def logistic(shift=0.0):
    def predict(states):
        margin = F.col("score_home") - F.col("score_away")
        return states.withColumn("home_win_prob", 1 / (1 + F.exp(-(margin * 0.2 + shift + F.col("pregame_prob") - 0.5))))

    return predict


def event(i, home, away, kind="Rebound", loc="h", game="g", final=False, arrival=0):
    period = min(4, 1 + i // 100)
    return (game, i, period, 700.0 - i % 100, loc, kind, None, None, home, away, final, arrival)


@pytest.fixture
def job(spark, tmp_path):
    games = spark.createDataFrame([("g", "live"), ("h", "scheduled"), ("k", "live")], "game_id string, status string")
    versions = {"now": "1"}

    def load():
        return logistic(0.0 if versions["now"] == "1" else 2.0), versions["now"]

    clock = {"t": 0.0}
    pointer = ModelPointer(lambda: versions["now"], load, every_s=600, clock=lambda: clock["t"])
    made = LiveJob(spark, str(tmp_path), pointer, lambda: games, lambda g: g.withColumn("pregame_prob", F.lit(0.5)))
    made.versions, made.ticks = versions, clock
    return made


def send(job, rows, batch_id):
    job.process_events(job.spark.createDataFrame(rows, FEED), batch_id)
    return emitted(job, batch_id)


def emitted(job, batch_id):
    rows = job.spark.read.parquet(f"{job.root}/points/source={job.source}/batch={batch_id}")
    return [(r["game_id"], r["action_id"]) for r in rows.orderBy("game_id", "action_id").collect()]


def test_only_new_states_are_emitted(job):
    first = [event(1, 2, 0), event(2, 2, 0, "Substitution"), event(3, 2, 3)]
    assert send(job, [*first, event(1, 2, 0, game="h"), event(1, 0, 0, game="zz")], 0) == [("g", 0), ("g", 1), ("g", 3)]
    assert send(job, first, 1) == []
    more = [*first, event(4, 4, 3), event(5, 4, 3, loc="v")]
    assert send(job, more, 2) == [("g", 4), ("g", 5)]
    # A retried batch overwrites itself and gives the same points.
    assert send(job, more, 2) == [("g", 4), ("g", 5)]
    # The end: the last state comes again as certain, once; the feed sent again emits nothing.
    closing = [(*r[:10], True, 9) for r in more]
    assert send(job, closing, 3) == [("g", 5)]
    last = job.recorded().where("action_id = 5").first()
    assert last["home_win_prob"] == 1.0 and job.progress().where("NOT finished").count() == 0
    assert send(job, closing, 4) == [] and send(job, more, 5) == []
    # Once the table has the game as final, nothing needs to be remembered.
    job.games = lambda: job.spark.createDataFrame([("g", "final")], "game_id string, status string")
    assert send(job, closing, 6) == [] and job.progress().count() == 0 and send(job, closing, 7) == []
    texts = [r["points"] for r in job.messages().where("game_id = 'g' AND type = 'points'").collect()]
    assert sum(t.count('"action_id"') for t in texts) == 6


def test_tasks_of_a_batch_follow_its_rows(job, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "TASK_ROWS", 4)
    key, seen, scored = "spark.sql.shuffle.partitions", [], job.model.load()[0]

    def predict(states):
        seen.append((states.sparkSession.conf.get(key), spark.conf.get(key)))
        return scored(states)

    job.model.load = lambda: (predict, "1")
    before = spark.conf.get(key)
    rows = [event(i, i, 0) for i in range(1, 81)]
    spark.createDataFrame(rows, FEED).coalesce(1).write.parquet(f"{tmp_path}/feed")
    job.start(live.read_feed(spark, f"{tmp_path}/feed"), f"{tmp_path}/checkpoint", available_now=True).awaitTermination()
    assert seen == [("20", "20")] and spark.conf.get(key) == before
    assert job.recorded().count() == 81
    assert "REPARTITION_BY_NUM" in job.recorded()._jdf.queryExecution().executedPlan().toString()
    # A batch of few rows keeps the session's number.
    send(job, [event(90, 2, 0)], 7)
    assert seen[-1] == (before, before)


def test_a_late_event_is_not_emitted_but_counts(job):
    send(job, [event(1, 0, 0), event(5, 0, 0, kind="Foul", loc="v")], 0)
    assert job.recorded().where("action_id = 5").first()["possession"] == 1
    # A rebound by the visitors is inserted before action 5: not emitted, yet it moves the ball.
    send(job, [event(1, 0, 0), event(3, 0, 0, loc="v"), event(5, 0, 0, kind="Foul", loc="v"), event(6, 0, 0, kind="Foul")], 1)
    got = {r["action_id"]: r["possession"] for r in job.recorded().collect()}
    assert got == {0: 0, 1: 1, 5: 1, 6: -1}


def test_a_promoted_model_takes_over_without_restart(job):
    send(job, [event(1, 2, 0)], 0)
    job.versions["now"] = "2"
    send(job, [event(1, 2, 0), event(2, 2, 0)], 1)  # not checked again yet
    job.ticks["t"] = 601.0
    send(job, [event(1, 2, 0), event(2, 2, 0), event(3, 2, 0)], 2)
    rows = {r["action_id"]: (r["model_version"], round(r["home_win_prob"], 4)) for r in job.recorded().collect()}
    assert rows[1] == rows[2] and rows[1][0] == "1"
    assert rows[3][0] == "2" and rows[3][1] > rows[2][1]


def test_pregame_estimate_is_fixed_at_the_start(job):
    send(job, [event(1, 0, 0)], 0)
    job.estimates = lambda g: g.withColumn("pregame_prob", F.lit(0.9))
    send(job, [event(1, 0, 0), event(2, 0, 0), event(1, 0, 0, game="k")], 1)
    p = {r["game_id"]: r["home_win_prob"] for r in job.recorded().where("action_id > 0").collect()}
    assert p["g"] == pytest.approx(0.5) and p["k"] > 0.55


def test_board_closes_open_games_and_never_touches_finals(job, spark):
    send(job, [event(1, 2, 0), event(1, 3, 9, game="k")], 0)
    board = spark.createDataFrame(
        [("g", "final", 80, 70, 1), ("k", "live", 3, 9, 1), ("g", "live", 1, 1, 0), ("zz", "live", 1, 1, 0), ("f", "live", 1, 1, 0), ("h", "scheduled", 0, 0, 0)],
        "game_id string, status string, home_score int, away_score int, arrival int",
    )
    points = job.closing_points(board.where("arrival = 1")).collect()
    assert [(r["game_id"], r["action_id"], r["home_win_prob"]) for r in points] == [("g", 1, 1.0)]
    assert {r["game_id"] for r in job.known_board(board).collect()} == {"g", "k", "h"}
    games = spark.createDataFrame(
        [("g", "live", 2, 0), ("k", "live", 0, 0), ("f", "final", 99, 98), ("h", "scheduled", None, None)],
        "game_id string, status string, home_score int, away_score int",
    )
    got = {r["game_id"]: tuple(r)[1:] for r in job.update_games(games, board).collect()}
    assert got == {"g": ("final", 80, 70), "k": ("live", 3, 9), "f": ("final", 99, 98), "h": ("scheduled", None, None)}


def test_pending_and_time_limit(spark):
    now = datetime(2030, 1, 1, 20)
    games = spark.createDataFrame([("a",), ("b",)], "game_id string")

    def board(*rows):
        return spark.createDataFrame(rows, "game_id string, status string, tip_time_utc timestamp")

    assert live.games_pending(board(("a", "live", None)), games, now)
    assert live.games_pending(board(("a", "scheduled", None)), games, now)
    assert live.games_pending(board(("a", "scheduled", datetime(2030, 1, 2, 1))), games, now)
    assert not live.games_pending(board(("a", "scheduled", datetime(2030, 1, 2, 3)), ("b", "final", None), ("x", "live", None)), games, now)

    class Query:
        isActive, stopped = True, False

        def awaitTermination(self, seconds):
            return False

        def stop(self):
            self.stopped = True

    ticks, q = iter(range(100)), Query()
    assert live.run_until([q], lambda: False, max_seconds=3, clock=lambda: next(ticks)) == "time limit" and q.stopped
    assert live.run_until([Query()], lambda: True) == "idle"


def test_stream_over_landed_polls_matches_one_replay(job, spark, tmp_path):
    rows = [event(i, i // 2, i // 3, loc="hv"[i % 2]) for i in range(1, 61)]
    for poll in range(1, 4):
        sent = [(*r[:10], poll == 3, poll) for r in rows[: poll * 20]]
        spark.createDataFrame(sent, FEED).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    query = job.start(live.read_feed(spark, str(tmp_path / "feed"), 1), str(tmp_path / "ck"), available_now=True)
    query.awaitTermination()
    keep = ["game_id", "action_id", "possession", "home_win_prob"]
    streamed = sorted(tuple(r) for r in job.recorded().select(*keep).collect())
    assert len(streamed) == 61 and streamed[-1][3] == 1.0
    replayer = LiveJob(spark, job.root, job.model, job.games, job.estimates, "replay")
    stored = spark.createDataFrame(rows, FEED).drop("final", "arrival")
    for _ in range(2):
        replayed = sorted(tuple(r) for r in replayer.replay(stored).select(*keep).collect())
        assert replayed == streamed
    assert len(job.recorded().collect()) == 61
    assert replayer.messages().where("type = 'reset'").count() == 2


def test_live_and_replay_jobs(spark, tmp_path, monkeypatch):
    """Landed polls and boards become points in the snapshot table, and the games table follows."""
    import json
    import os

    from boutline.plans.jobs import Deployment

    at = Deployment(spark, str(tmp_path / "root"), str(tmp_path / "landing"), clock=lambda: datetime(2030, 1, 1, 12))
    games = spark.createDataFrame(
        [("0022900001", 2029, "live", None, None), ("0022900002", 2029, "final", 9, 8)],
        "game_id string, season int, status string, home_score int, away_score int",
    )
    at.tables.replace("core.games", games)
    monkeypatch.setattr(Deployment, "_ingame_model", lambda self: (logistic(), "7"))
    at._ahead = 0

    def put(path, doc):
        at._ahead += 10
        file = tmp_path / "landing" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(json.dumps(doc))
        os.utime(file, (1_900_000_000 + at._ahead,) * 2)

    def poll(n):
        actions = [
            {"actionId": i, "actionNumber": i, "period": 1, "clock": f"PT{11 - i:02d}M00.00S", "teamId": 1, "location": "h", "actionType": "Made Shot", "scoreHome": str(2 * i), "scoreAway": "0"}
            for i in range(1, n + 1)
        ]
        return {"game": {"gameId": "0022900001", "actions": actions}}

    def board(status, home):
        game = {"gameId": "0022900001", "gameStatus": status, "period": 4, "homeTeam": {"score": home}, "awayTeam": {"score": 0}, "gameTimeUTC": ""}
        return {"scoreboard": {"games": [game]}}

    put("live_pbp/a.json", poll(2))
    put("live_board/a.json", board(2, 4))
    assert at.live() == "caught up"
    points = at.tables.read("serving.live_wp_snapshots")
    assert sorted(r["action_id"] for r in points.collect()) == [0, 1, 2]
    put("live_pbp/b.json", poll(3))
    put("live_board/b.json", board(3, 6))
    at.live()
    rows = {r["action_id"]: r for r in at.tables.read("serving.live_wp_snapshots").collect()}
    assert sorted(rows) == [0, 1, 2, 3] and rows[3]["home_win_prob"] == 1.0 and rows[3]["source"] == "live"
    table = {r["game_id"]: (r["status"], r["home_score"]) for r in at.tables.read("core.games").collect()}
    assert table == {"0022900001": ("final", 6), "0022900002": ("final", 9)}
    put("live_pbp/c.json", poll(3))
    put("live_board/c.json", board(3, 6))
    at.live()
    assert at.tables.read("serving.live_wp_snapshots").count() == 4
    # Stored events of a finished game, as a replay beside the live points.
    at.tables.upsert(
        "core.pbp_events",
        spark.createDataFrame(
            [("0022900002", i, 1, 700.0 - i, "h", "Made Shot", 2 * i, 0, 2029) for i in (1, 2)],
            "game_id string, action_id long, period int, clock_seconds double, location string, action_type string, score_home int, score_away int, season int",
        ),
    )
    assert at.replay(["0022900002"]) == 3 and at.replay(["0022900002"]) == 3
    by_source = {r["source"]: r["count"] for r in at.tables.read("serving.live_wp_snapshots").groupBy("source").count().collect()}
    assert by_source == {"live": 4, "replay": 3}


FEED_GAME, OTHER = "0022900001", "0022900002"


class Landing:
    """Lands polls of one game for a deployment."""

    def __init__(self, spark, tmp_path, status):
        from boutline.plans.jobs import Deployment

        self.at = Deployment(spark, str(tmp_path / "root"), str(tmp_path / "landing"), clock=lambda: datetime(2030, 1, 1, 12))
        self.spark, self.tmp, self.moment = spark, tmp_path, 1_900_000_000
        games = [(FEED_GAME, 2029, status, None, None), (OTHER, 2029, "final", 9, 8)]
        self.at.tables.replace("core.games", spark.createDataFrame(games, "game_id string, season int, status string, home_score int, away_score int"))
        for folder in ("live_pbp", "live_board"):
            (tmp_path / "landing" / folder).mkdir(parents=True)

    def put(self, path, doc):
        import json
        import os

        self.moment += 10
        file = self.tmp / "landing" / path
        file.write_text(json.dumps(doc) if isinstance(doc, dict) else doc)
        os.utime(file, (self.moment,) * 2)

    def feed(self, name, n):
        actions = [
            {"actionId": i, "actionNumber": i, "period": 1, "clock": f"PT{11 - i:02d}M00.00S", "teamId": 1, "location": "h", "actionType": "Made Shot", "scoreHome": str(2 * i), "scoreAway": "0"}
            for i in range(1, n + 1)
        ]
        self.put(f"live_pbp/{name}.json", {"game": {"gameId": FEED_GAME, "actions": actions}})

    def board(self, name, status, home=0):
        game = {"gameId": FEED_GAME, "gameStatus": status, "period": 4, "homeTeam": {"score": home}, "awayTeam": {"score": 0}, "gameTimeUTC": ""}
        self.put(f"live_board/{name}.json", {"scoreboard": {"games": [game]}})

    def points(self):
        rows = self.at.tables.read("serving.live_wp_snapshots").collect()
        assert len({(r["game_id"], r["source"], r["action_id"]) for r in rows}) == len(rows)
        return {r["action_id"]: r["home_win_prob"] for r in rows}


@pytest.fixture
def landing(spark, tmp_path, monkeypatch):
    from boutline.plans.jobs import Deployment

    monkeypatch.setattr(Deployment, "_ingame_model", lambda self: (logistic(), "7"))
    return lambda status: Landing(spark, tmp_path, status)


def test_a_game_may_go_from_scheduled_to_final_in_one_run(landing):
    on = landing("scheduled")
    on.feed("a", 3)
    on.board("a", 3, home=6)
    on.at.live()
    points = on.points()
    assert sorted(points) == [0, 1, 2, 3] and points[3] == 1.0
    assert {r["game_id"]: r["status"] for r in on.at.tables.read("core.games").collect()} == {FEED_GAME: "final", OTHER: "final"}


def test_a_feed_waits_for_the_board(landing):
    on = landing("scheduled")
    on.feed("a", 2)
    on.board("a", 1)
    on.at.live()
    assert on.points() == {}
    on.board("b", 2)  # no feed is landed again
    on.at.live()
    assert sorted(on.points()) == [0, 1, 2]
    on.board("c", 3, home=4)
    on.at.live()
    assert sorted(on.points()) == [0, 1, 2] and on.points()[2] == 1.0


def test_readers_see_points_between_batches_and_pruning_stays(landing, spark):
    from boutline.streaming.live import SNAPSHOTS

    on = landing("live")
    job = on.at.live_job()
    empty = spark.createDataFrame([], "game_id string, status string, home_score int, away_score int, tip_time_utc timestamp, arrival struct<a:int>")
    for batch, n in enumerate((2, 3, 5)):
        rows = spark.createDataFrame([event(i, 2 * i, 0, game=FEED_GAME) for i in range(1, n + 1)], FEED)
        for _ in range(2):  # a retried batch changes nothing
            job.process_poll(rows, empty, batch, on.at.tables)
            assert sorted(on.points()) == list(range(n + 1))
    on.at.tables.rewrite(SNAPSHOTS, lambda points: points.where("action_id IN (0, 5)").repartition("shard"))
    rows = spark.createDataFrame([event(i, 2 * i, 0, game=FEED_GAME) for i in range(1, 7)], FEED)
    job.process_poll(rows, empty, 3, on.at.tables)
    assert sorted(on.points()) == [0, 5, 6]
    assert on.at.tables.compact(SNAPSHOTS, most=1) and sorted(on.points()) == [0, 5, 6]
    assert len(on.at.tables._commits(SNAPSHOTS)) == 1
    for batch in range(4, 8):
        job.process_poll(rows, empty, batch, on.at.tables)
    kept = {int(n.split("=")[1]) for n in on.at.tables._list(f"{job.root}/points/source=live")}
    assert kept == {5, 6, 7}, "recorded batches do not grow without end"


def test_a_dead_stream_ends_the_run():
    class Query:
        def __init__(self, error=None):
            self.isActive, self.error, self.stopped = error is None, error, False

        def awaitTermination(self, seconds):
            return False

        def exception(self):
            return self.error

        def stop(self):
            self.stopped = True

    healthy = Query()
    with pytest.raises(RuntimeError, match="board"):
        live.run_until([healthy, Query(RuntimeError("board stream"))], lambda: False)
    assert healthy.stopped


def test_the_change_log_in_any_order_gives_the_stored_series(landing, spark):
    import random

    from boutline.streaming import changes
    from boutline.streaming.live import SNAPSHOTS

    on = landing("live")
    job = on.at.live_job()
    board = "game_id string, status string, home_score int, away_score int, tip_time_utc timestamp, arrival struct<a:int>"
    for batch, n in enumerate((2, 2, 4, 700)):
        rows = spark.createDataFrame([event(i, 1 + i % 3, 0, game=FEED_GAME) for i in range(1, n + 1)], FEED)
        ended = [(FEED_GAME, "final", 2, 0, None, (1,))] if batch == 3 else []
        job.process_poll(rows, spark.createDataFrame(ended, board), batch, on.at.tables)
        if batch == 2:
            early = [r.asDict() for r in job.snapshot(on.at.tables.read(SNAPSHOTS)).collect()]
    log = [r.asDict() for r in job.messages().collect()]
    assert sorted({(r["type"], r["seq"], r["previous"]) for r in log}, key=str) == [("closing", 14, 13), ("points", 1, None), ("points", 13, 9), ("points", 9, 1)]
    assert len(early) == 1 and early[0]["seq"] == 9 and sum(r["seq"] == 13 for r in log) == 2
    frame = lambda rows: spark.createDataFrame([tuple(r[f.split()[0]] for f in changes.MESSAGE.split(", ")) for r in rows], changes.MESSAGE)
    series = lambda df: sorted((r["action_id"], r["home_win_prob"], r["score_home"]) for r in df.collect())
    want = series(on.at.tables.read(SNAPSHOTS))
    assert len(want) == 701 and want[-1][1] == 1.0
    rng = random.Random(1)
    late = [r for r in log if r["seq"] > 9]
    for start in (log, [*early, *late], [*early, *log]):
        mixed = start + rng.sample(start, 2)
        rng.shuffle(mixed)
        assert series(changes.read_series(frame(mixed))) == want
        assert changes.gaps(frame(mixed)).collect() == []
    lost = [r for r in log if r["seq"] != 9]
    assert {(r["seq"], r["missing"]) for r in changes.gaps(frame(lost)).collect()} == {(13, 9)}
    cut = [r for r in log if (r["seq"], r["part"]) != (13, 1)]
    assert {(r["seq"], r["missing"]) for r in changes.gaps(frame(cut)).collect()} == {(13, 13)}
    # A reset starts the series anew, and a snapshot from before it no longer counts.
    again = [{**log[0], "type": "reset", "seq": 16, "previous": None, "part": None, "parts": None, "points": None}]
    assert changes.read_series(frame([*early, *log, *again])).collect() == []
