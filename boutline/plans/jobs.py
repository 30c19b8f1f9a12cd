"""Batch jobs over a deployment's tables and landing folder.

Landing layout (JSON, plain or .gz):
  schedule/season=<s>/*, gamelog/season=<s>/*, pbp/season=<s>/<game>*, board/day=<yyyymmdd>/*,
  summary/season=<s>/<game>*
Fetching is not part of this package; scheduling is external."""

from __future__ import annotations

import argparse
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.functions.calendar import EASTERN
from boutline.operators import incremental
from boutline.operators.evaluation import reliability
from boutline.operators.features import FEATURE_VERSION, build_features, features_as_json, features_from_json
from boutline.operators.latest import latest_by
from boutline.operators.ratings import first_change, rate_since, rating_inputs, rating_rows
from boutline.operators.retention import prune
from boutline.operators.states import training_states
from boutline.operators.teamgames import prepare_games
from boutline.operators.upsert import final_stays_final, mark_tasks, request_key, resolve_ids
from boutline.plans import backtest, ingame, ingest, monitor, registry, rules, scoring
from boutline.session import local_session, materialise
from boutline.sources import board_feed, dimensions, documents, stats_feed
from boutline.sources.tables import PUBLISHED, TABLES, Tables
from boutline.streaming import live

DETAIL_CHARS = 2000
MINTED_PREFIX = "ext-"
LANDED = ("schedule", "gamelog", "pbp", "board", "summary")
RESPONSES, LOADED = "raw.api_responses", "raw.loaded_documents"


def eastern_day(now: datetime) -> date:
    """The day on the league's calendar."""
    return now.astimezone(ZoneInfo(EASTERN)).date()


def season_of_day(day: date) -> int:
    return day.year if day.month >= 8 else day.year - 1


@dataclass
class Deployment:
    spark: SparkSession
    root: str
    landing: str
    clock: Callable[[], datetime] = lambda: datetime.now(UTC)
    first_season: int = backtest.FIRST_SEASON
    first_event_season: int = ingame.FIRST_SEASON
    min_event_games: int = 1000
    # Retention of live history: points kept per finished game, seasons kept. None keeps everything.
    keep_points: int | None = None
    keep_seasons: int | None = None
    pregame_params: dict[str, Any] | None = None
    ingame_params: dict[str, Any] | None = None
    n_test_seasons: int = backtest.N_TEST_SEASONS

    def __post_init__(self) -> None:
        self.tables = Tables(self.spark, self.root)

    def now(self) -> datetime:
        """The clock's time with its zone; a clock without one runs in UTC."""
        now = self.clock()
        return now if now.tzinfo else now.replace(tzinfo=UTC)

    # ------------------------------------------------------------ audit

    def recorded(self, job: str, work: Callable[[], Any]) -> Any:
        """Run `work`, with a job-run row going from running to success or failed."""
        run = {"id": str(uuid.uuid4()), "job": job, "started_at": self.now()}

        def write(status: str, detail: str | None, finished: datetime | None) -> None:
            row = [(run["id"], job, run["started_at"], finished, status, detail and detail[:DETAIL_CHARS])]
            schema = self.tables.schema("serving.job_runs")
            self.tables.upsert("serving.job_runs", self.spark.createDataFrame(row, schema))

        write("running", None, None)
        try:
            result = work()
        except Exception as error:
            write("failed", f"{type(error).__name__}: {error}", self.now())
            raise
        write("success", None if result is None else str(result), self.now())
        return result

    def _stored(self, kind: str, parts: list[str]) -> DataFrame:
        """Stored documents of the wanted partitions (seasons or days) of one landing folder."""
        slots = [f"{kind}-{p.replace('=', '-')}" for p in parts]
        return self.tables.read(RESPONSES).where(F.col("slot").isin(slots)).withColumnRenamed("fetched_at", "fetched")

    def _unloaded(self, kind: str, parts: list[str]) -> DataFrame:
        """(slot, subject, document, fetched) of stored documents that no ingestion has loaded yet."""
        stored = self._stored(kind, parts).select("slot", "subject", "document", "fetched")
        slots = [f"{kind}-{p.replace('=', '-')}" for p in parts]
        loaded = self.tables.read(LOADED).where(F.col("slot").isin(slots)).select("document", F.col("fetched_at").alias("fetched"))
        return stored.join(loaded, ["document", "fetched"], "left_anti")

    def _documents(self, kind: str, parts: list[str], schema: str) -> DataFrame | None:
        """All stored documents of the partitions, parsed; None without any."""
        stored = self._stored(kind, parts)
        return None if not parts or stored.isEmpty() else documents.parse_texts(stored, schema)

    def _changed(self, kind: str, parts: list[str], force: bool = False) -> list[str]:
        """The partitions with a document that no ingestion has loaded yet; all, if forced."""
        if force:
            return parts
        slots = {r[0] for r in self._unloaded(kind, parts).select("slot").distinct().collect()}  # seasons or days asked for
        return [p for p in parts if f"{kind}-{p.replace('=', '-')}" in slots]

    def _loaded(self, docs: DataFrame) -> None:
        """Note documents (document, fetched) as loaded, after their rows and marks are written."""
        known = self.tables.read(LOADED).select("slot", "document", "fetched_at")
        found = docs.select(documents.slot_of(F.col("document")).alias("slot"), "document", F.col("fetched").alias("fetched_at"))
        fresh = found.distinct().join(known, known.columns, "left_anti")
        self.tables.append(LOADED, fresh.withColumn("loaded_at", F.lit(self.now())))

    def _mark_again(self, keys: DataFrame) -> DataFrame:
        """Record one more attempt of tasks whose documents are those already loaded, with the same outcome."""
        ledger = self.tables.read("raw.ingestion_runs").join(keys.select("task_key").distinct(), "task_key", "left_semi")
        again = ledger.select("task_key", "status", "rows", "error", F.lit(self.now()).alias("updated_at"))
        again = materialise(again, f"marks/{uuid.uuid4()}")
        if not again.isEmpty():
            self.tables.rewrite("raw.ingestion_runs", lambda old: mark_tasks(old, again))
        return again

    def _keys(self, keys: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(k,) for k in keys], "task_key string")

    def _mark(self, marks: DataFrame) -> DataFrame:
        """Record one mark per task: it failed if any of its documents failed."""
        failed = F.bool_or(F.col("status") == "failed")
        marks = materialise(
            marks.groupBy("task_key").agg(
                F.when(failed, "failed").otherwise("success").alias("status"),
                F.when(~failed, F.sum("rows")).alias("rows"),
                F.max("error").alias("error"),
            ).withColumn("updated_at", F.lit(self.now())),
            f"marks/{uuid.uuid4()}",
        )
        self._reject("document", marks.where("status = 'failed'").select(F.col("task_key").alias("subject"), F.col("error").alias("reason")))
        self.tables.rewrite("raw.ingestion_runs", lambda ledger: mark_tasks(ledger, marks))
        return marks

    def _reject(self, kind: str, rows: DataFrame) -> None:
        """Keep what could not be loaded (subject, reason)."""
        if not rows.isEmpty():
            stamped = rows.distinct().select(F.lit(kind).alias("kind"), "subject", "reason", F.lit(self.now()).alias("rejected_at"))
            self.tables.append("raw.rejects", stamped)

    # ------------------------------------------------------------ ingestion

    def land(self, kinds: tuple[str, ...] = LANDED, parts: list[str] | None = None) -> int:
        """Store landed documents (of `parts` such as `season=2030`, or all) that are not stored as they are
        now: told by path, time and size from a listing, so that only new ones are opened. A request is the
        document's folder and name up to the first dot or @; every version stays, and what is loaded once
        is never read from the landing folder again. Returns the number of requests stored."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.landing).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        folders = [f"{self.landing}/{kind}{'' if p is None else '/' + p}" for kind in kinds for p in (parts or [None])]
        found = [f for f in folders if fs.exists(path(f))]
        if found:
            self._store_new(found)
        return self.tables.read(RESPONSES).select("request_key").distinct().count()

    def _store_new(self, folders: list[str]) -> None:
        known = self.tables.read(RESPONSES).select("document", F.col("fetched_at").alias("fetched"), "bytes")
        fresh = documents.list_files(self.spark, folders).join(known, ["document", "fetched", "bytes"], "left_anti")
        fresh = materialise(fresh.where(documents.slot_of(F.col("document")) != ""), f"fresh/{uuid.uuid4()}")
        oldest = fresh.agg(F.min(F.unix_micros("fetched"))).first()[0]
        if oldest is None:
            return
        # Only folders with something new, and there no file older than the oldest new one.
        place = [F.regexp_extract("document", documents.PLACE, i).alias(n) for i, n in ((1, "k"), (2, "n"), (3, "v"))]
        changed = fresh.select(*place).distinct().collect()  # kinds by seasons or days
        texts = documents.read_texts(self.spark, [f"{self.landing}/{r['k']}/{r['n']}={r['v']}" for r in changed], oldest)
        texts = texts.join(fresh.select("document"), "document", "left_semi")
        endpoint, part = (F.regexp_extract("document", documents.PLACE, i) for i in (1, 2))
        part = F.concat_ws("=", part, F.regexp_extract("document", documents.PLACE, 3))
        name = documents.name_of(F.col("document"))
        params = F.create_map(F.lit("part"), part, F.lit("name"), name)
        # A feed of events says itself which game it is of.
        named = F.when(endpoint == "pbp", F.get_json_object("payload", "$.game.gameId"))
        self.tables.append(RESPONSES, texts.select(
            request_key(F.lit("landing"), endpoint, params).alias("request_key"),
            F.lit("landing").alias("source"), endpoint.alias("endpoint"), params.alias("params"),
            F.coalesce(named, name).alias("subject"), "document", F.col("fetched").alias("fetched_at"), "bytes",
            F.sha2("payload", 256).alias("checksum"), "payload", documents.slot_of(F.col("document")).alias("slot"),
        ))

    def seed_teams(self) -> None:
        self.tables.upsert("core.teams", dimensions.teams(self.spark))

    def _pending(self, kind: str, seasons: list[int], skip_done: Callable[[int], bool]) -> list[int]:
        done = {
            r[0]
            for r in self.tables.read("raw.ingestion_runs")
            .where("status = 'success'")
            .where(F.col("task_key").isin([f"{kind}:{s}" for s in seasons]))
            .select("task_key")
            .collect()
        }
        return [s for s in seasons if not (skip_done(s) and f"{kind}:{s}" in done)]

    def ingest_seasons(
        self, first: int, last: int, today: date, events: bool = True, force: bool = False, logs: bool = True
    ) -> DataFrame:
        """Schedules, game logs and play-by-play of a season range: all pending documents of a
        kind are parsed by one job. Completed seasons already loaded are skipped. `logs` and
        `events` leave out game logs and play-by-play."""
        self.seed_teams()
        current = season_of_day(today)
        seasons = list(range(first, last + 1))
        kinds = ("schedule", *(("gamelog",) if logs else ()), *(("pbp",) if events else ()))
        self.land(kinds, [f"season={s}" for s in seasons])
        marks = []
        season_key = F.regexp_extract("document", r"season=(\d+)", 1)

        wanted = [f"season={s}" for s in self._pending("schedule", seasons, lambda s: not force and s < current)]
        scheduled = self._changed("schedule", wanted, force)
        same = [f"schedule:{p[7:]}" for p in wanted if p not in scheduled]
        docs = self._documents("schedule", scheduled, stats_feed.SCHEDULE)
        if docs is not None:
            self.tables.upsert("core.games", stats_feed.parse_schedule(docs), guard=final_stays_final)
            size = F.size("leagueSchedule.gameDates")
            marks.append(self._mark(documents.outcomes(docs, "leagueSchedule", F.concat(F.lit("schedule:"), season_key), size)))
            self._loaded(docs)

        wanted = [f"season={s}" for s in self._pending("gamelog", seasons, lambda s: not force and s < current)] if logs else []
        # A log is read again with a new schedule too: that may name the home side of more games.
        logged = sorted({*self._changed("gamelog", wanted, force), *(p for p in scheduled if p in wanted)})
        same += [f"gamelog:{p[7:]}" for p in wanted if p not in logged]
        docs = self._documents("gamelog", logged, stats_feed.GAME_LOG)
        if docs is not None:
            of = [int(p[7:]) for p in logged]
            known = self.tables.read("core.games").where(F.col("season").isin(of)).select("game_id", "home_team_id")
            games, stats, rejects = stats_feed.parse_game_logs(docs, known)
            # Written once, then merged twice.
            games = materialise(games, f"gamelog/{uuid.uuid4()}")
            stats = stats.join(games.select("game_id", "season"), "game_id")
            self.tables.upsert("core.games", games, guard=final_stays_final)
            self.tables.upsert("core.team_game_stats", stats)
            self._reject("game log", rejects.select(F.col("game_id").alias("subject"), "reason"))
            size = F.size(F.col("resultSets")[0]["rowSet"])
            marks.append(self._mark(documents.outcomes(docs, "resultSets", F.concat(F.lit("gamelog:"), season_key), size)))
            self._loaded(docs)

        if same:
            marks.append(self._mark_again(self._keys(same)))
        if events:
            marks.append(self._load_events(seasons, force))
        out = marks[0] if marks else self.tables.read("raw.ingestion_runs").limit(0)
        for more in marks[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    def ingest_games(self, game_ids: list[str]) -> DataFrame:
        """Play-by-play of the named games, loaded again if they have it already."""
        games = self.tables.read("core.games").where(F.col("game_id").isin(game_ids))
        seasons = [r[0] for r in games.select("season").distinct().collect()]  # of the games named
        if not seasons:
            return self.tables.read("raw.ingestion_runs").limit(0)
        self.land(("pbp",), [f"season={s}" for s in seasons])
        return self._load_events(seasons, True, game_ids)

    def _load_events(self, seasons: list[int], force: bool, only: list[str] | None = None) -> DataFrame:
        """Events of finished games that have none yet (all, if forced) and of which a document came
        in; failed tasks without a new document are marked again as they were."""
        first, last = min(seasons), max(seasons)
        games = self.tables.read("core.games").where("status = 'final'").where(F.col("season").between(first, last))
        if only is not None:
            games = games.where(F.col("game_id").isin(only))
        wanted = games if force else ingest.games_missing_events(games, self.tables.read("raw.ingestion_runs"), first, last)
        parts = [f"season={s}" for s in seasons]
        stored = self._stored("pbp", parts)
        have = stored.select("subject", "document", "fetched").join(wanted.select(F.col("game_id").alias("subject")), "subject", "left_semi")
        fresh = have if force else have.join(self._unloaded("pbp", parts).select("subject"), "subject", "left_semi")
        newest = materialise(documents.newest_documents(fresh, F.col("subject")), f"wanted/{uuid.uuid4()}")
        old = have.join(newest.select("subject"), "subject", "left_anti")
        again = self._mark_again(old.select(F.concat(F.lit("pbp:"), "subject").alias("task_key")))
        if newest.isEmpty():
            return again
        texts = stored.join(newest.select("document", "fetched"), ["document", "fetched"], "left_semi")
        docs = documents.parse_texts(texts, stats_feed.PLAY_BY_PLAY)
        docs = docs.join(newest.select("document", "fetched", F.col("subject").alias("__game")), ["document", "fetched"])
        marks = documents.outcomes(docs, "game", F.concat(F.lit("pbp:"), "__game"), F.size("game.actions"))
        marks = materialise(marks, f"marks/{uuid.uuid4()}")
        rows = stats_feed.parse_play_by_play(docs).join(games.select("game_id", "season"), "game_id")
        self.tables.upsert("core.pbp_events", rows)
        marks = self._mark(marks)
        # Older versions of a game's document are settled with its newest.
        self._loaded(stored.join(newest.select("subject"), "subject", "left_semi"))
        return marks.unionByName(again)

    def ingest_board(self, today: date, events: bool = True) -> DataFrame:
        """Second provider's daily run: recent and stale days, then boxes and plays of finished
        games that have none yet."""
        days = [r[0] for r in ingest.days_to_refresh(self.tables.read("core.games"), today).collect()]
        self._load_days(days)
        return self.ingest_summaries(season_of_day(today), events)

    def ingest_board_season(self, season: int, events: bool = True) -> DataFrame:
        """All landed days of a season from the second provider, then boxes and plays."""
        first = date(season, 8, 1)
        self._load_days([first + timedelta(days=i) for i in range((date(season + 1, 8, 1) - first).days)])
        return self.ingest_summaries(season, events)

    def _load_days(self, days: list[date]) -> None:
        self.seed_teams()
        games = self.tables.read("core.games")
        parts = [f"day={d:%Y%m%d}" for d in days]
        if not parts:
            return
        self.land(("board",), parts)
        changed = self._changed("board", parts)
        self._mark_again(self._keys([f"day:{p[4:]}" for p in parts if p not in changed]))
        docs = self._documents("board", changed, board_feed.SCOREBOARD)
        if docs is not None:
            feed = board_feed.parse_scoreboard(docs)
            rows = resolve_ids(feed, games, MINTED_PREFIX).drop("document", "period", "clock")
            self.tables.upsert("core.games", materialise(rows, f"board/{uuid.uuid4()}"), guard=final_stays_final)
            day_key = F.regexp_extract("document", r"day=(\d+)", 1)
            self._mark(documents.outcomes(docs, "events", F.concat(F.lit("day:"), day_key), F.size("events")))
            self._loaded(docs)

    def ingest_summaries(self, season: int, events: bool = True) -> DataFrame:
        missing = ingest.games_missing_box(self.tables.read("core.games"), self.tables.read("core.team_game_stats"), season)
        part = [f"season={season}"]
        self.land(("summary",), part)
        stored = self._stored("summary", part)
        have = stored.select("subject", "document", "fetched").join(missing.select(F.col("game_id").alias("subject")), "subject", "left_semi")
        fresh = have.join(self._unloaded("summary", part).select("subject"), "subject", "left_semi")
        newest = materialise(documents.newest_documents(fresh, F.col("subject")), f"wanted/{uuid.uuid4()}")
        old = have.join(newest.select("subject"), "subject", "left_anti")
        again = self._mark_again(old.select(F.concat(F.lit("game:"), "subject").alias("task_key")))
        if newest.isEmpty():
            return again
        texts = stored.join(newest.select("document", "fetched"), ["document", "fetched"], "left_semi")
        chosen = documents.parse_texts(texts, board_feed.SUMMARY)
        chosen = chosen.join(newest.select("document", "fetched", F.col("subject").alias("game_id")), ["document", "fetched"])
        marks = materialise(
            documents.outcomes(chosen, "boxscore", F.concat(F.lit("game:"), "game_id"), F.size("boxscore.teams")),
            f"marks/{uuid.uuid4()}",
        )
        box, rejects = board_feed.parse_box(chosen)
        self._reject("box score", rejects.select(F.col("game_id").alias("subject"), "reason"))
        box = materialise(box.drop("document").withColumn("season", F.lit(season)), f"box/{uuid.uuid4()}")
        if events:
            plays = board_feed.parse_plays(chosen).drop("document").withColumn("season", F.lit(season))
            self.tables.upsert("core.pbp_events", plays)
        self.tables.upsert("core.team_game_stats", box)
        marks = self._mark(marks)
        self._loaded(stored.join(newest.select("subject"), "subject", "left_semi"))
        return marks.unionByName(again)

    # ------------------------------------------------------------ features

    def build_features(self, save: bool = True) -> DataFrame:
        """Features and ratings of every game from the core tables, replacing the stored ones."""
        games, stats = self.tables.read("core.games"), self.tables.read("core.team_game_stats")
        arenas, moved = dimensions.arenas(self.spark), dimensions.relocations(self.spark)
        prepared = self._prepared()
        rated, inputs, day = self._rated(prepared)
        built = build_features(games, stats, arenas, moved, dimensions.SHARED_SITE, rated)
        features = materialise(built, f"features/{uuid.uuid4()}")
        if save:
            self.tables.replace("features.game_features", features_as_json(features, keep=("season",)))
            self._save_ratings(games, rated, inputs, day)
            self.tables.replace("features.feature_inputs", incremental.feature_inputs(prepared, stats))
        return features

    def _prepared(self) -> DataFrame:
        """Games with their sites. All teams of a deployment may meet: one pool."""
        arenas, moved = dimensions.arenas(self.spark), dimensions.relocations(self.spark)
        games = self.tables.read("core.games")
        return prepare_games(games, arenas, moved, dimensions.SHARED_SITE).withColumn("pool", F.lit("league"))

    def _rated(self, prepared: DataFrame) -> tuple[DataFrame, DataFrame, date | None]:
        """Ratings of all games, of which only those from the earliest changed one on are folded again."""
        stored, inputs = self.tables.read("features.elo_ratings"), materialise(rating_inputs(prepared), f"rating_inputs/{uuid.uuid4()}")
        day = first_change(inputs, self.tables.read("features.rating_inputs"))
        return materialise(rate_since(prepared, stored, day), f"rated/{uuid.uuid4()}"), inputs, day

    def update_features(self) -> int:
        """Bring stored features and ratings up to what `build_features` would store, computing form
        only for games that a changed game touches and writing only seasons in which a row moves. All
        is built where nothing is stored, another version is, a season is gone or a team's seasons
        overlap. Returns the number of games computed."""
        games, stats = self.tables.read("core.games"), self.tables.read("core.team_game_stats")
        before, stored = self.tables.read("features.feature_inputs"), self.tables.read("features.game_features")
        prepared = self._prepared()
        inputs = materialise(incremental.feature_inputs(prepared, stats), f"feature_inputs/{uuid.uuid4()}")
        whole = before.isEmpty() or not stored.where(~F.col("feature_version").eqNullSafe(F.lit(FEATURE_VERSION))).isEmpty()
        whole = whole or not before.join(inputs.select("season"), "season", "left_anti").isEmpty()
        if whole or not incremental.seasons_in_order(inputs, before):
            return self.build_features().count()
        changed = materialise(incremental.changed_games(inputs, before), f"changed/{uuid.uuid4()}")
        rated, rating_in, day = self._rated(prepared)
        if day is None and changed.isEmpty():
            return 0
        touched = materialise(incremental.touched_games(inputs, changed), f"touched/{uuid.uuid4()}")
        # Seasons to write: of touched games, of games that were there, of games whose rating moved.
        seasons = touched.select("season").unionByName(changed.where("was IS NOT NULL").select("was.season"))
        if day is not None:
            old = self.tables.read("features.elo_ratings").select("game_id", "team_id", F.col("elo_pre").alias("was"))
            now = rating_rows(games, rated).where(F.col("game_date") >= F.lit(day)).join(old, ["game_id", "team_id"], "left")
            seasons = seasons.unionByName(now.where(~F.col("elo_pre").eqNullSafe(F.col("was"))).select("season"))
        written = [r[0] for r in seasons.distinct().collect()]  # bounded by the number of seasons
        if written:
            fresh = incremental.touched_features(prepared, stats, rated, touched)
            kept = stored.where(F.col("season").isin(written)).join(touched.select("game_id"), "game_id", "left_anti")
            kept = incremental.with_ratings(features_from_json(kept), rated)
            rows = features_as_json(fresh, keep=("season",)).unionByName(features_as_json(kept, keep=("season",)))
            self.tables.replace_partitions("features.game_features", rows)
        self._save_ratings(games, rated, rating_in, day)
        # Last, so that an update that did not end is done again.
        moved = changed.select(F.explode(F.array("now.season", "was.season")).alias("season")).where("season IS NOT NULL").distinct()
        self.tables.replace_partitions("features.feature_inputs", inputs.join(moved, "season", "left_semi"))
        return touched.count()

    def _save_ratings(self, games: DataFrame, rated: DataFrame, inputs: DataFrame, day: date | None) -> None:
        """Rewrite the seasons in which ratings may have moved; all, if games are gone."""
        if day is None:
            return
        rows, before = rating_rows(games, rated), self.tables.read("features.rating_inputs")
        gone = [before.join(inputs, c, "left_anti") for c in ("game_id", "season")]
        if before.isEmpty() or not all(g.isEmpty() for g in gone):
            self.tables.replace("features.elo_ratings", rows)
        else:
            # A game that moved to another day may have left a season: rows of both are written.
            moved = inputs.where(F.col("game_date") >= F.lit(day)).select("season")
            moved = moved.unionByName(before.where(F.col("game_date") >= F.lit(day)).select("season")).distinct()
            self.tables.replace_partitions("features.elo_ratings", rows.join(moved, "season", "left_semi").select(*rows.columns))
        self.tables.replace("features.rating_inputs", inputs)

    # ------------------------------------------------------------ models

    def train_pregame(self, today: date) -> registry.Registration:
        model, report = backtest.train(
            self.build_features(save=False), today, self.pregame_params, self.n_test_seasons, self.first_season
        )
        season, logloss = report.latest()
        pooled = report.metrics.where("season IS NULL AND variant = 'model'").first().asDict()
        by_season = report.metrics.where("season IS NOT NULL AND variant = 'model'").collect()
        stored = {
            "pooled_model": {k: pooled[k] for k in ("logloss", "brier", "accuracy", "ece", "n")},
            "alternatives": report.alternatives,
            "acceptance": report.acceptance(),
            "reliability": [r.asDict() for r in report.reliability().collect()],
            "seasons": [r.asDict() for r in report.metrics.where("season IS NOT NULL").collect()],
        }
        return registry.register(
            self.tables,
            registry.PREGAME,
            model,
            season,
            logloss,
            report.acceptance(),
            self.now(),
            metrics={f"pooled_{k}": v for k, v in stored["pooled_model"].items()},
            artifacts={"backtest.json": stored},
            tags={f"{rules.TAG_PREFIX}{r['season']}": repr(r["logloss"]) for r in by_season},
        )

    def train_ingame(self) -> registry.Registration | None:
        games, events = self.tables.read("core.games"), self.tables.read("core.pbp_events")
        seasons = sorted(
            r[0] for r in ingest.seasons_with_events(games, events, self.min_event_games).collect() if r[0] >= self.first_event_season
        )
        if len(seasons) < 2:
            return None
        estimates = backtest.out_of_sample(self.build_features(save=False), seasons, self.pregame_params, self.first_season)
        states = training_states(events.where(F.col("season").isin(seasons)), games, estimates)
        frame = materialise(states, f"states/{uuid.uuid4()}", ["season"])
        model, report = ingame.train_and_evaluate(frame, self.ingame_params)
        values = report.values()
        return registry.register(
            self.tables,
            registry.INGAME,
            model,
            report.test_season,
            values["model"]["logloss"],
            report.acceptance(),
            self.now(),
            metrics={f"{part}_{k}": v for part, m in values.items() for k, v in m.items()},
            artifacts={"evaluation.json": values, "reliability.json": [r.asDict() for r in report.curve.collect()]},
        )

    def retrain(self, today: date) -> str:
        return f"{self.train_pregame(today)}; {self.train_ingame()}"

    # ------------------------------------------------------------ scoring and monitoring

    def predict(self, start: date | None = None, days: int = 7, only_scheduled: bool = True) -> str:
        """Score the coming games with the production model; unchanged predictions are kept."""
        now = self.now()
        start = start or eastern_day(now)
        model, version = registry.load_production(self.tables, registry.PREGAME)
        registry.snapshot_version(self.tables, version, now)

        def wanted() -> DataFrame:
            return scoring.target_games(
                self.tables.read("core.games"),
                self.tables.read("features.game_features").drop("season"),
                start,
                start + timedelta(days=days - 1),
                only_scheduled,
                model.feature_version,
            )

        rows = wanted()
        if not rows.where("stale").isEmpty():
            self.update_features()
            rows = wanted()
        frame = features_from_json(rows.select("game_id", "game_date", "features"))
        history = self.tables.read("serving.predictions").join(rows.select("game_id"), "game_id", "left_semi")
        fresh = scoring.score(rows, frame, history, model.predict_and_explain, version, model.feature_version, now)
        fresh = materialise(fresh, f"scored/{uuid.uuid4()}")
        self.tables.append("serving.predictions", fresh)
        games, written = rows.count(), fresh.count()
        return f"{games} games scored with version {version} ({written} new predictions)"

    def monitor(self, today: date, min_games: dict[str, int] | None = None) -> str:
        expected = registry.pooled_expected(self.tables).unionByName(registry.heldout(self.tables, registry.INGAME))
        now = self.now()
        results = monitor.run_monitor(
            self.tables.read("serving.predictions"),
            self.tables.read("serving.live_wp_snapshots"),
            self.tables.read("core.games"),
            expected,
            today,
            min_games,
        )
        stamped = results.select(
            "*", F.lit(now).alias("run_at"), F.xxhash64("model", "window", F.lit(now)).alias("id")
        )
        stored = materialise(stamped, f"monitor/{uuid.uuid4()}")
        self.tables.append("serving.monitoring_runs", stored)
        # Four rows: two models, two windows.
        return "; ".join(f"{r['model']}/{r['window']}: {r['status']}" for r in stored.collect())

    def prune_history(self, today: date) -> None:
        games, current = self.tables.read("core.games"), season_of_day(today)
        self.tables.rewrite(
            "serving.live_wp_snapshots",
            lambda points: prune(points, games, self.keep_points, current, self.keep_seasons).repartition("shard"),
        )

    def daily(self, today: date, board: bool = False) -> str:
        """Nightly: ingest, bring features up to date, score the coming week, monitor; thin and drop
        old live history only where the deployment says how much to keep."""
        season = season_of_day(today)
        marks = self.ingest_board(today) if board else self.ingest_seasons(season, season, today)
        tasks = marks.select(F.lit("daily").alias("job"), "task_key", F.col("status").alias("outcome"))
        summary = ingest.run_summary(tasks, ["job"]).first()
        self.update_features()
        if registry.production_version(self.tables, registry.PREGAME) is not None:
            self.predict()
        self.monitor(today)
        for name in (RESPONSES, LOADED):
            self.tables.compact(name)
        for name in ("core.games", "core.team_game_stats", "core.pbp_events"):
            self.tables.compact_partitions(name)
        # The live job may be reading its points; they are cleaned by the pruning that follows.
        for name in TABLES:
            if name != "serving.live_wp_snapshots":
                self.tables.vacuum(name)
        if self.keep_points or self.keep_seasons:
            self.prune_history(today)
        if summary is None:
            return "0 succeeded, 0 skipped, 0 failed"
        return f"{summary['succeeded']} succeeded, {summary['skipped']} skipped, {summary['failed']} failed"

    # ------------------------------------------------------------ live

    def live_job(self, source: str = "live") -> live.LiveJob:
        """The live path of this deployment: production in-game model, latest pre-game estimates."""
        pointer = live.ModelPointer(
            lambda: registry.production_version(self.tables, registry.INGAME), lambda: self._ingame_model()
        )

        def estimates(games: DataFrame) -> DataFrame:
            features = features_from_json(self.tables.read("features.game_features").select("game_id", "features"))
            return scoring.pregame_estimates(games, self.tables.read("serving.predictions"), features)

        return live.LiveJob(
            self.spark, f"{self.root}/live", pointer, lambda: self.tables.read("core.games"), estimates, source, self.now
        )

    def _ingame_model(self) -> tuple[live.Predict, str]:
        model, version = registry.load_production(self.tables, registry.INGAME)
        return model.predict, str(version)

    def live(self, watch: bool = False, max_seconds: float | None = None) -> str:
        """Follow landed polls (`live_pbp/*`, `live_board/*`): what has landed, or, with `watch`,
        until no game is live or about to start. One stream reads both, so that each batch can open
        games by the board, follow the feed, and then close games; after every batch its points are
        in the snapshot table. A failure of the stream ends the run with its reason."""
        job = self.live_job()
        events = documents.stream_documents(self.spark, f"{self.landing}/live_pbp", stats_feed.PLAY_BY_PLAY)
        boards = documents.stream_documents(self.spark, f"{self.landing}/live_board", stats_feed.SCOREBOARD)

        def poll(docs: DataFrame, n: int) -> None:
            feed, board = live.split_polls(docs)
            job.process_poll(live.feed_rows(feed), live.board_rows(board), n, self.tables)

        query = live.run_documents(
            live.joint_polls(events, boards), poll, f"{self.root}/live/checkpoints/polls", live.EVENTS_SECONDS, not watch
        )
        if watch:
            idle = lambda: not live.table_pending(self.tables.read("core.games"), self.now())
            return live.run_until([query], idle, max_seconds)
        query.awaitTermination()
        return "caught up"

    def replay(self, game_ids: list[str]) -> int:
        """Run stored events of finished games through the live path, under source `replay`."""
        job = self.live_job("replay")
        events = self.tables.read("core.pbp_events").where(F.col("game_id").isin(game_ids))
        points = job.replay(events).where(F.col("game_id").isin(game_ids))
        job.store(self.tables, points, replace=True)
        return job.recorded().count()

    def publish(self, target_root: str) -> dict[str, int]:
        """Copy what readers need into another root, with the production models, and release it there:
        readers of `Tables(...).released()` see the tables all as before or all as now. What the release
        before last held is deleted at the next publishing, so its readers have until then to end."""
        target = Tables(self.spark, target_root)
        if target.newest_release() is not None:
            for name in PUBLISHED:
                target.vacuum(name)
        counts = self.tables.copy_to(target, PUBLISHED)
        for name in (registry.PREGAME, registry.INGAME):
            if registry.production_version(self.tables, name) is not None:
                registry.copy_production(self.tables, target, name)
        target.make_release()
        return counts

    def calibration_curve(self, model: str = registry.PREGAME) -> DataFrame:
        rows = monitor.pregame_rows(
            self.tables.read("serving.predictions"), self.tables.read("core.games"), season_of_day(eastern_day(self.now()))
        )
        return reliability(rows.where(F.col("model") == model), [], "home_win", "home_win_prob")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="boutline")
    parser.add_argument("job", choices=[
        "land", "backfill", "schedule", "games", "board-season", "daily", "features", "update-features", "train", "train-ingame", "retrain",
        "predict", "monitor", "live", "replay", "publish",
    ])
    parser.add_argument("--root", required=True)
    parser.add_argument("--landing", default="")
    parser.add_argument("--today", type=date.fromisoformat, help="the day to run for; today by the league's calendar if left out")
    parser.add_argument("--first", type=int)
    parser.add_argument("--last", type=int)
    parser.add_argument("--days", type=int, default=7)
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--board", action="store_true", help="use the second provider's documents")
    parser.add_argument("--watch", action="store_true", help="keep following until no game is pending")
    parser.add_argument("--max-seconds", type=float)
    parser.add_argument("--no-events", action="store_true", help="leave play-by-play out")
    parser.add_argument("--game", action="append", default=[], help="a game of the games or replay job; may be repeated")
    parser.add_argument("--target")
    parser.add_argument("--keep-points", type=int, help="thin finished games to so many live points; all if left out")
    parser.add_argument("--keep-seasons", type=int, help="drop live points of older seasons; none if left out")
    args = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    at = Deployment(spark, args.root, args.landing, keep_points=args.keep_points, keep_seasons=args.keep_seasons)
    today = args.today or eastern_day(at.now())
    work = {
        "land": at.land,
        "backfill": lambda: at.ingest_seasons(args.first, args.last, today, not args.no_events, args.force).count(),
        "schedule": lambda: at.ingest_seasons(args.first, args.last, today, False, True, logs=False).count(),
        "games": lambda: at.ingest_games(args.game).count(),
        "board-season": lambda: at.ingest_board_season(args.first, not args.no_events).count(),
        "daily": lambda: at.daily(today, args.board),
        "features": lambda: at.build_features().count(),
        "update-features": at.update_features,
        "train": lambda: at.train_pregame(today),
        "train-ingame": at.train_ingame,
        "retrain": lambda: at.retrain(today),
        "predict": lambda: at.predict(today, args.days),
        "monitor": lambda: at.monitor(today),
        "live": lambda: at.live(args.watch, args.max_seconds),
        "replay": lambda: at.replay(args.game),
        "publish": lambda: json.dumps(at.publish(args.target)),
    }[args.job]
    print(at.recorded(args.job, work))


if __name__ == "__main__":
    main()
