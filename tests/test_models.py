"""Models, registry, jobs and tables."""

import json
from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from boutline.functions.prob import settle
from boutline.plans import backtest, ingame, monitor, pregame, registry
from boutline.plans.jobs import Deployment
from boutline.sources.tables import Tables

SMALL = {"trees": 4, "least_rows": 20, "rate": 0.1}


def test_contributions_add_up_to_the_log_odds(spark, league):
    data = league.features().where("home_win IS NOT NULL")
    model = pregame.fit(data.where("season < 1999"), params=SMALL)
    test = data.where("season = 1999")
    scored = model.explain(test, top_k=len(model.features)).select("game_id", "factors")
    raw = model.raw(test).select("game_id", "raw_prob")
    total = F.aggregate("factors", F.lit(0.0), lambda a, f: a + f["contribution"])
    rows = scored.join(raw, "game_id").select(total.alias("s"), F.log(F.col("raw_prob") / (1 - F.col("raw_prob"))).alias("m")).collect()
    # What is left over is the base value, the same for every row.
    base = {round(r["m"] - r["s"], 6) for r in rows}
    assert len(base) == 1
    sizes = [abs(f["contribution"]) for f in scored.first()["factors"]]
    assert sizes == sorted(sizes, reverse=True)
    assert sum(model.importance().values()) == pytest.approx(1.0)
    p = model.predict(test).agg(F.min("home_win_prob"), F.max("home_win_prob")).first()
    assert 0.001 <= p[0] <= p[1] <= 0.999


def test_walk_forward_never_trains_on_the_tested_season(league, monkeypatch):
    seen = []
    real = backtest.predict_season

    def spy(data, season, calibration, models):
        model = models[season - 1] if calibration == "isotonic" else models[season]
        seen.append((season, calibration, max(model.train_seasons)))
        return real(data, season, calibration, models)

    monkeypatch.setattr(backtest, "predict_season", spy)
    data = league.features().where("status = 'final' AND season >= 1995")
    report = backtest.walk_forward(data, [1999], {"trees": 2, "least_rows": 20}, "t-walk")
    assert seen == [(1999, "none", 1998), (1999, "isotonic", 1997)]
    assert report.metrics.count() == 4 and set(report.alternatives) == {"pooled_logloss_none", "pooled_logloss_isotonic"}
    assert min(report.alternatives, key=report.alternatives.get).endswith(report.calibration)
    leaking = {1999: pregame.fit(data.where("season <= 1999"), params=SMALL)}
    with pytest.raises(ValueError, match="leaked"):
        real(data, 1999, "none", leaking)


def test_registered_queries_fit_with_production_parameters(spark, league, monkeypatch):
    """Every fit has the production parameters, each distinct training set is fitted once, and four
    seasons get out-of-sample rows."""
    from boutline.catalog import modelling

    fits = []
    real = pregame.boosting.fit

    def few(frame, features, label, models, params, name="boosting"):
        fits.append((len(models), params))
        return real(frame, features, label, models, replace(params, trees=1), name)

    monkeypatch.setattr(pregame.boosting, "fit", few)
    metrics = modelling.m5_walk_forward(league)
    assert {r["season"] for r in metrics.collect()} == {1997, 1998, 1999, 2000, None}
    scored = modelling.m8_out_of_sample(league)
    final = league.features().where("status = 'final' AND season BETWEEN 1997 AND 2000")
    assert rows_of_ids(scored) == rows_of_ids(final)
    modelling.m2_pregame_scores(league), modelling.m3_calibrated_scores(league)
    modelling.m4_factors(league), modelling.m17_batch_scores(league)
    production = pregame.Params(trees=300, leaves=8, rate=0.02, rows=0.8, columns=0.7, least_rows=200, l2=10.0)
    assert fits == [(n, production) for n in (5, 4, 1, 1, 1, 1)]


def test_walk_forward_writes_no_copy_of_its_rows_and_calibration_scores_once(league, monkeypatch):
    written = []
    for module in (backtest, pregame):
        real = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, name, real=real: written.append(name) or real(df, name))
    data = league.features().where("status = 'final' AND season >= 1995")
    backtest.walk_forward(data, [1999], {"trees": 2, "least_rows": 20}, "t-once")
    assert sorted(written) == ["calibration", "t-once/metrics", "t-once/predictions"]


def test_ingame_scores_read_states_that_are_written_once(league, monkeypatch):
    from boutline.catalog import modelling

    written, real = [], modelling.materialise
    monkeypatch.setattr(modelling, "materialise", lambda df, name: written.append(name) or real(df, name))
    fit = ingame.fit
    monkeypatch.setattr(ingame, "fit", lambda frame: fit(frame, {"trees": 1, "least_rows": 20}))
    scored = modelling.m10_ingame_scores(league)
    assert written == ["m10/states"] and scored.count() == modelling._frame(league).count()


def rows_of_ids(df):
    return sorted(r["game_id"] for r in df.select("game_id").collect())


@pytest.fixture(scope="module")
def states(spark):
    rng = [(g, (g * 37 + a * 11) % 61 - 30, 2880 - 28 * a, (g + a) % 3 - 1, 0.2 + (g % 7) / 10) for g in range(60) for a in range(100)]
    df = spark.createDataFrame(rng, "g int, margin int, left int, possession int, pregame_prob double")
    p = 1 / (1 + F.exp(-(F.col("margin") * 0.2 + (F.col("pregame_prob") - 0.5) * 2)))
    return df.select(
        F.col("g").cast("string").alias("game_id"),
        (1 + F.floor((2880 - F.col("left")) / 720)).cast("int").alias("period"),
        (50 + F.col("margin")).alias("score_home"),
        F.lit(50).alias("score_away"),
        "possession",
        F.col("left").cast("double").alias("seconds_remaining"),
        "pregame_prob",
        (F.rand(5) < p).cast("int").alias("home_win"),
        (2015 + F.col("g") % 3).alias("season"),
    )


def test_ingame_model_is_monotone_and_certain_at_the_end(spark, states):
    model, report = ingame.train_and_evaluate(states)
    assert report.test_season == 2017 and report.acceptance()["beats_pregame_only"]
    assert set(report.values()) == {"model", "pregame_only", "Q1", "Q2", "Q3", "Q4"}
    grid = [(m, t, po, q) for m in range(-20, 21, 4) for t in (0.0, 5.0, 700.0, 2000.0) for po in (-1, 0, 1) for q in (0.2, 0.5, 0.8)]
    df = spark.createDataFrame(grid, "m int, seconds_remaining double, possession int, pregame_prob double").select(
        "*", (50 + F.col("m")).alias("score_home"), F.lit(50).alias("score_away"), F.lit(4).alias("period")
    )
    p = {(r["m"], r["seconds_remaining"], r["possession"], r["pregame_prob"]): r["home_win_prob"] for r in model.predict(df).collect()}
    for m, t, po, q in grid:
        for more in ((m + 4, t, po, q), (m, t, po + 1, q), (m, t, po, round(q + 0.3, 1))):
            if more in p:
                assert p[more] >= p[(m, t, po, q)] - 1e-12
    feed = spark.createDataFrame(
        [("g", 1, 4, 0.0, 99, 98, "Rebound", None, "h", None)],
        "game_id string, action_id long, period int, clock_seconds double, score_home int, score_away int, "
        "action_type string, sub_type string, location string, description string",
    )
    watched = ingame.score_events(model, feed, spark.createDataFrame([("g", 0.6)], "game_id string, pregame_prob double"))
    assert [r["home_win_prob"] for r in watched.orderBy("action_id").collect()][1] == 1.0 and watched.count() == 2
    assert p[(4, 0.0, 0, 0.5)] == 1.0 and p[(-4, 0.0, 1, 0.8)] == 0.0 and 0 < p[(0, 0.0, 0, 0.5)] < 1


def test_settle_needs_the_fourth_period(spark):
    rows = spark.createDataFrame([(0.4, 3, 0.0, 3), (0.4, 3, 0.0, 4), (0.4, 0, 0.0, 5), (0.4, -1, 0.0, 6)], "p double, d int, t double, q int")
    out = [r[0] for r in rows.select(settle(*(F.col(c) for c in "pdtq"))).collect()]
    assert out == [0.4, 1.0, 0.4, 0.0]


def test_registry_promotes_only_better_versions(spark, states, tmp_path):
    tables = Tables(spark, str(tmp_path / "a"))
    model = ingame.fit(states, {"trees": 5})
    now = datetime(2030, 1, 1)

    def add(loss, season=2017, ok=True):
        r = registry.register(tables, registry.INGAME, model, season, loss, {"calibrated": ok}, now)
        return r.version, r.promoted, r.reason

    assert add(0.5) == (1, True, "no production model yet")
    assert add(0.5) == (2, False, "log loss 0.5000 >= production v1 0.5000")
    assert add(0.4, ok=False) == (3, False, "failed acceptance: calibrated")
    assert add(0.6, 2018) == (4, True, "production v1 was not evaluated on 2018")
    assert add(0.59, 2018)[1:] == (True, "log loss 0.5900 < production v4 0.6000")
    assert registry.production_version(tables, registry.INGAME) == 5
    assert tables.read(registry.TABLE).where("is_production").count() == 1
    target = Tables(spark, str(tmp_path / "b"))
    assert registry.copy_production(tables, target, registry.INGAME) == 5
    loaded, version = registry.load_production(target, registry.INGAME)
    assert version == "5" and loaded.train_seasons == [2015, 2016, 2017]
    a, b = (m.predict(states).agg(F.sum("home_win_prob")).first()[0] for m in (model, loaded))
    assert a == pytest.approx(b)


def test_judge_branches(spark):
    rows = [("pregame", "season", f"g{i}", "7" if i % 3 else "8", 0.9, int(i % 10 > 0)) for i in range(250)]
    rows += [("pregame", "last_30_days", f"g{i}", "7", 0.9, 1) for i in range(10)]
    rows += [("ingame", "season", f"g{i}", "1", 0.6, int(i % 5 > 1)) for i in range(25)]
    df = spark.createDataFrame(rows, "model string, window string, game_id string, model_version string, home_win_prob double, home_win int")
    kinds = df.select("model", "window").distinct()
    expected = spark.createDataFrame([("pregame", "7", 0.2), ("ingame", "2", 0.1)], "model string, model_version string, logloss double")
    got = {(r["model"], r["window"]): r for r in monitor.judge(df, expected, kinds).collect()}
    season = got["pregame", "season"]
    assert season["status"] == "warning" and season["model_version"] == "7" and season["games"] == 250
    assert season["message"].startswith("Worse than expected: Log loss 0.325 over 250 games, expected about 0.200.")
    few = got["pregame", "last_30_days"]
    assert (few["status"], few["message"]) == ("insufficient", "10 finished games with predictions; at least 50 are needed.")
    assert got["ingame", "season"]["message"].endswith("; no held-out log loss to compare with.") and got["ingame", "season"]["status"] == "ok"


def test_tables_replace_upsert_and_copy(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    assert tables.read("core.teams").count() == 0
    games = spark.createDataFrame(
        [("a", 2000, "final", 9), ("b", 2000, "scheduled", None), ("c", 2001, "live", 3)],
        "game_id string, season int, status string, home_score int",
    )
    tables.replace("core.games", games)
    new = spark.createDataFrame([("b", 2000, "final", 7), ("d", 2000, "live", 1)], games.schema)
    tables.upsert("core.games", new)
    assert tables._commits("core.games") == [(1, "full"), (2, "part")]
    assert [p.split("/")[-2:] for p in sorted(tables._current_paths("core.games"))] == [
        ["commit=00000001-full", "season=2001"],
        ["commit=00000002-part", "season=2000"],
    ]
    got = {r["game_id"]: (r["status"], r["home_score"]) for r in tables.read("core.games").collect()}
    assert got == {"a": ("final", 9), "b": ("final", 7), "c": ("live", 3), "d": ("live", 1)}
    tables.rewrite("core.games", lambda df: df.where("season = 2001"))
    assert tables.version("core.games") == 3 and tables.read("core.games").count() == 1
    tables.append("core.games", games.where("season = 2001"))
    assert tables.read("core.games").count() == 2
    tables.rewrite("core.games", lambda df: df.limit(1))
    tables.vacuum("core.games")
    assert tables._list(f"{tables.root}/core/games") == ["commit=00000005-full"]
    target = Tables(spark, str(tmp_path / "u"))
    assert tables.copy_to(target, ["core.games", "core.teams"]) == {"core.games": 1, "core.teams": 0}


def land(league, root):
    """The fixture league as landed feed documents."""
    games = league.games().collect()
    stats = {(r["game_id"], r["team_id"]): r for r in league.stats().collect()}
    base = 1610612737
    names = "MIN PTS FGM FGA FG3M FG3A FTM FTA OREB DREB REB AST STL BLK TOV PF PLUS_MINUS".split()
    headers = ["SEASON_ID", "TEAM_ID", "GAME_ID", "GAME_DATE", "MATCHUP", "WL", *names]
    by_season = {}
    for g in games:
        by_season.setdefault(g["season"], []).append(g)
    for season, rows in by_season.items():
        log, schedule = [], []
        for g in rows:
            gid = "002" + g["game_id"][3:]
            tip = g["tip_time_utc"].strftime("%Y-%m-%dT%H:%M:%SZ") if g["tip_time_utc"] else ""
            sides = {k: {"teamId": base + g[f"{k[:4]}_team_id"], "score": g[f"{k[:4]}_score"] or 0} for k in ("homeTeam", "awayTeam")}
            status = {"scheduled": 1, "live": 2, "final": 3}[g["status"]]
            schedule.append({"gameId": gid, "gameStatus": status, "gameDateEst": f"{g['game_date']}T00:00:00Z", "gameDateTimeUTC": tip, "isNeutral": bool(g["is_neutral"]), **sides})
            if g["status"] != "final":
                continue
            for t, o, sep in ((g["home_team_id"], g["away_team_id"], "vs."), (g["away_team_id"], g["home_team_id"], "@")):
                s = stats.get((g["game_id"], t))
                if s is None:
                    continue
                values = [s["minutes"], s["pts"], s["fgm"], s["fga"], s["fg3m"], s["fg3a"], s["ftm"], s["fta"], s["oreb"], s["dreb"], 40, 20, 5, 4, s["tov"], 18, s["plus_minus"]]
                log.append([f"2{season}", base + t, gid, str(g["game_date"]), f"T{t} {sep} T{o}", "W" if s["plus_minus"] > 0 else "L", *values])
        for kind, doc in (
            ("schedule", {"leagueSchedule": {"seasonYear": f"{season}-{(season + 1) % 100:02d}", "gameDates": [{"games": schedule}]}}),
            ("gamelog", {"resultSets": [{"headers": headers, "rowSet": log}]}),
        ):
            path = root / kind / f"season={season}"
            path.mkdir(parents=True)
            (path / "doc.json").write_text(json.dumps(doc))


def test_jobs_end_to_end(spark, league, tmp_path):
    land(league, tmp_path / "landing")
    at = Deployment(
        spark, str(tmp_path / "root"), str(tmp_path / "landing"), clock=lambda: datetime(2001, 5, 30, 12),
        first_season=1995, pregame_params=SMALL, n_test_seasons=1,
    )
    today = date(2001, 5, 30)
    marks = at.ingest_seasons(1994, 2000, today, events=False)
    assert {r["status"] for r in marks.collect()} == {"success"} and marks.count() == 14
    assert at.tables.read("core.games").count() == league.games().where("season <= 2000").count()
    # Completed seasons are skipped on a second run; the current one is loaded again.
    again = at.ingest_seasons(1994, 2000, today, events=False)
    assert {r["task_key"] for r in again.collect()} == {"schedule:2000", "gamelog:2000"}
    ledger = {r["task_key"]: r["attempts"] for r in at.tables.read("raw.ingestion_runs").collect()}
    assert ledger["schedule:2000"] == 2 and ledger["schedule:1999"] == 1
    ours, theirs = at.build_features(), league.features()
    pair = ours.select(F.substring("game_id", 4, 7).alias("g"), "home_std_net", "away_streak").join(
        theirs.where("season <= 2000").select(F.substring("game_id", 4, 7).alias("g"), F.col("home_std_net").alias("n"), F.col("away_streak").alias("s")), "g"
    )
    differ = ~F.col("home_std_net").eqNullSafe(F.col("n")) | ~F.col("away_streak").eqNullSafe(F.col("s"))
    assert pair.where(differ).count() == 0 and pair.count() > 500
    registration = at.recorded("retrain", lambda: at.train_pregame(today))
    assert registration.version == 1
    # The acceptance bar is not the point here: make the version the production one.
    at.tables.rewrite(registry.TABLE, lambda df: df.withColumn("is_production", F.lit(True)))
    first = at.recorded("predict", lambda: at.predict(date(2001, 5, 25), 30, only_scheduled=False))
    n = at.tables.read("serving.predictions").count()
    assert n > 0 and first == f"{n} games scored with version 1 ({n} new predictions)"
    assert at.predict(date(2001, 5, 25), 30, only_scheduled=False) == f"{n} games scored with version 1 (0 new predictions)"
    assert at.monitor(today).count("insufficient") == 4
    assert at.tables.read("serving.monitoring_runs").where("status = 'insufficient'").count() > 0
    with pytest.raises(ZeroDivisionError):
        at.recorded("bad", lambda: 1 / 0)
    runs = {r["job"]: r["status"] for r in at.tables.read("serving.job_runs").collect()}
    assert runs == {"retrain": "success", "predict": "success", "bad": "failed"}
    counts = at.publish(str(tmp_path / "published"))
    assert counts["serving.predictions"] == n and counts["core.games"] == at.tables.read("core.games").count()
    assert registry.production_version(Tables(spark, str(tmp_path / "published")), registry.PREGAME) == 1
    assert at.daily(today).startswith("2 succeeded")
    # Nothing has changed since: no game is rated again, no rating is written.
    version = at.tables.version("features.elo_ratings")
    at.build_features()
    assert at.tables.version("features.elo_ratings") == version


def test_second_provider_day(spark, tmp_path):
    """A board day and a summary: the known game keeps its id, a new one gets a minted id."""
    from tests.test_sources import event, summary, write

    landing = tmp_path / "landing"
    write(landing, "board/day=20310101/b.json", {"events": [event("1"), event("9", home="18", away="2")]})
    write(landing, "summary/season=2030/0023000077.json", summary())
    write(landing, "summary/season=2030/ext-9.json", "{broken")
    at = Deployment(spark, str(tmp_path / "root"), str(landing), clock=lambda: datetime(2031, 1, 2, 12))
    stored = spark.createDataFrame(
        [("0023000077", 2030, "regular", date(2031, 1, 1), 1610612738, 1610612752, "scheduled")],
        "game_id string, season int, season_type string, game_date date, home_team_id long, away_team_id long, status string",
    )
    at.tables.replace("core.games", stored)
    marks = at.ingest_board(date(2031, 1, 2))
    games = {r["game_id"]: r for r in at.tables.read("core.games").collect()}
    assert set(games) == {"0023000077", "ext-9"}
    assert (games["0023000077"]["provider_id"], games["0023000077"]["status"], games["0023000077"]["home_score"]) == ("1", "final", 101)
    assert at.tables.read("core.team_game_stats").where("game_id = '0023000077'").count() == 2
    assert at.tables.read("core.pbp_events").count() == 12
    assert {r["task_key"]: r["status"] for r in marks.collect()} == {"game:0023000077": "success", "game:ext-9": "failed"}
    ledger = {r["task_key"]: r["status"] for r in at.tables.read("raw.ingestion_runs").collect()}
    assert ledger["day:20310101"] == "success" and ledger["game:ext-9"] == "failed"


def test_things_landed_twice(spark, tmp_path):
    """A schedule, a game log and a game's events landed again replace the earlier ones; a broken
    document of a task makes the task fail, and what cannot be loaded is listed."""
    import os

    landing = tmp_path / "landing"
    base = 1610612737
    names = "MIN PTS FGM FGA FG3M FG3A FTM FTA OREB DREB REB AST STL BLK TOV PF PLUS_MINUS".split()
    headers = ["SEASON_ID", "TEAM_ID", "GAME_ID", "GAME_DATE", "MATCHUP", "WL", *names]

    def put(path, doc, age):
        file = landing / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(doc if isinstance(doc, str) else json.dumps(doc))
        os.utime(file, (1_900_000_000 - age, 1_900_000_000 - age))

    def schedule(status):
        sides = {"homeTeam": {"teamId": base, "score": 100}, "awayTeam": {"teamId": base + 1, "score": 90}}
        game = {"gameId": "0022900001", "gameStatus": status, "gameDateEst": "2029-11-01T00:00:00Z", "gameDateTimeUTC": "", "isNeutral": False, **sides}
        return {"leagueSchedule": {"seasonYear": "2029-30", "gameDates": [{"games": [game]}]}}

    def log(pts, *more):
        rows = [
            ["22029", base + i, "0022900001", "2029-11-01", ("A vs. B", "B @ A")[i], "WL"[i], 240, p, 40, 80, 10, 30, 10, 12, 8, 30, 38, 20, 5, 4, 9, 18, d]
            for i, (p, d) in enumerate(((pts, pts - 90), (90, 90 - pts)))
        ]
        return {"resultSets": [{"headers": headers, "rowSet": [*rows, *more]}]}

    def plays(*descriptions):
        actions = [
            {"actionId": i, "actionNumber": i, "period": 1, "clock": f"PT{11 - i:02d}M00.00S", "teamId": base, "location": "h", "actionType": "Made Shot", "description": d, "isFieldGoal": 1, "shotValue": 2, "scoreHome": str(2 * i), "scoreAway": "0"}
            for i, d in enumerate(descriptions, 1)
        ]
        return {"game": {"gameId": "0022900001", "actions": actions}}

    put("schedule/season=2029/a.json", schedule(1), 50)
    put("schedule/season=2029/b.json", schedule(3), 10)
    put("gamelog/season=2029/a.json", log(95), 50)
    put("gamelog/season=2029/b.json", log(100, ["22029", base + 2, "0022900002", "2029-11-02", "A vs. B", "W", *[1] * 17]), 10)
    put("gamelog/season=2029/broken.json", "{", 5)
    put("pbp/season=2029/0022900001.json", plays("old", "old"), 50)
    put("pbp/season=2029/0022900001@2.json", plays("new", "new", "new"), 10)
    at = Deployment(spark, str(tmp_path / "root"), str(landing), clock=lambda: datetime(2030, 1, 1, 12))
    marks = {r["task_key"]: r["status"] for r in at.ingest_seasons(2029, 2029, date(2030, 1, 1)).collect()}
    assert marks == {"schedule:2029": "success", "gamelog:2029": "failed", "pbp:0022900001": "success"}
    games = at.tables.read("core.games").collect()
    assert [(g["game_id"], g["status"], g["home_score"]) for g in games] == [("0022900001", "final", 100)]
    assert sorted(r["pts"] for r in at.tables.read("core.team_game_stats").collect()) == [90, 100]
    assert [r["description"] for r in at.tables.read("core.pbp_events").collect()] == ["new"] * 3
    rejects = {(r["kind"], r["subject"]) for r in at.tables.read("raw.rejects").collect()}
    assert rejects == {("game log", "0022900002"), ("document", "gamelog:2029")}
    assert at.land() == 6 and at.land() == 6
    # Loading one game again, and the schedule alone.
    put("pbp/season=2029/0022900001@3.json", plays("newest"), 1)
    at.ingest_games(["0022900001"])
    assert at.tables.read("core.pbp_events").where("description = 'newest'").count() == 1
    assert at.ingest_seasons(2029, 2029, date(2030, 1, 1), events=False, logs=False).count() == 1
    with pytest.raises(ValueError, match="repeat keys"):
        at.tables.upsert("core.teams", spark.createDataFrame([(1, "A"), (1, "B")], "team_id long, abbreviation string"))


def test_nightly_run_keeps_all_history_unless_told(spark, tmp_path):
    games = spark.createDataFrame(
        [("g", 2020, "final", date(2020, 12, 1)), ("h", 2029, "final", date(2029, 12, 1))],
        "game_id string, season int, status string, game_date date",
    )
    points = spark.range(1000).selectExpr("id", "IF(id < 500, 'g', 'h') AS game_id", "id AS action_id", "'live' AS source")
    for limits, left in (({}, 1000), ({"keep_points": 100}, 200), ({"keep_points": 100, "keep_seasons": 1}, 100)):
        at = Deployment(spark, str(tmp_path / f"root{left}"), str(tmp_path / "none"), clock=lambda: datetime(2030, 1, 1, 12), **limits)
        at.tables.replace("core.games", games)
        at.tables.replace("serving.live_wp_snapshots", points)
        at.daily(date(2030, 1, 1))
        assert at.tables.read("serving.live_wp_snapshots").count() == left


def test_times_do_not_depend_on_the_machines_zone(spark, tmp_path, monkeypatch):
    import time
    from datetime import UTC

    from boutline.plans.jobs import eastern_day

    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        for i, now in enumerate((datetime(2030, 1, 1, 3), datetime(2030, 1, 1, 3, tzinfo=UTC))):
            at = Deployment(spark, str(tmp_path / str(i)), "", clock=lambda now=now: now)
            at.recorded("nothing", lambda: None)
            started = at.tables.read("serving.job_runs").select(F.unix_seconds("started_at")).first()[0]
            assert started == int(datetime(2030, 1, 1, 3, tzinfo=UTC).timestamp())
            assert eastern_day(at.now()) == date(2029, 12, 31)
    finally:
        monkeypatch.undo()
        time.tzset()
