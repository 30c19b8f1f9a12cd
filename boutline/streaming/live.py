"""Live win probability on Structured Streaming.

Feeds re-send a game's whole event list at every poll. Each micro-batch therefore recomputes the
states of the games it holds with the same operator that builds training states, and emits only
what lies past the game's last emitted action. What must survive between batches (last action
and probability, the pre-game estimate fixed at the start, the last state) is one row per open
game in a small versioned table; a game whose final point is out stays there as finished, so that
a feed sent again emits nothing, until the games table has it as final. Feeds of known games that no board has
called live yet wait beside it. All writes go to folders named after the batch, so a retried batch
overwrites its own output.

A poll holds a feed and a board. The board opens games first, then the feed is followed, then the
board closes games: nothing is lost when one batch takes a game from scheduled to final."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boutline.operators.latest import latest_by
from boutline.operators.states import STATE_COLUMNS, game_states, tip_off, with_times
from boutline.operators.upsert import update_from_scoreboard
from boutline.session import dealt, materialise, shuffles_of, tasks_for
from boutline.sources import stats_feed
from boutline.sources.tables import Tables
from boutline.streaming import changes

# Seconds between scoreboard reads, event reads and model checks.
SCOREBOARD_SECONDS = 30
EVENTS_SECONDS = 10
MODEL_CHECK_SECONDS = 600
# How far ahead a scheduled start keeps a time-limited run alive.
PENDING_WITHIN = timedelta(hours=6)
SNAPSHOTS = "serving.live_wp_snapshots"
SHARDS = 256  # of the snapshot table, per source: a batch rewrites those of its games only
TASK_ROWS = 250_000  # feed rows or points of a task: about 30 MB as they are shuffled
KEPT_BATCHES = 3  # of recorded points, progress and waiting feeds

FEED = (
    "game_id string, action_id long, period int, clock_seconds double, location string, action_type string, "
    "sub_type string, description string, score_home int, score_away int, final boolean, arrival long"
)
PROGRESS = (
    "game_id string, pregame_prob double, last_action_id long, last_prob double, period int, clock_seconds double, "
    "score_home int, score_away int, possession int, description string, finished boolean, sent long"
)
POINT = [
    "game_id", "action_id", "period", "clock_seconds", "elapsed_seconds", "score_home", "score_away",
    "possession", "home_win_prob", "description",
]

Predict = Callable[[DataFrame], DataFrame]


@dataclass
class ModelPointer:
    """The production model, looked up again at most every `every_s` seconds; a newly promoted
    version is picked up at the next batch without a restart."""

    current_version: Callable[[], str | None]
    load: Callable[[], tuple[Predict, str]]
    every_s: float = MODEL_CHECK_SECONDS
    clock: Callable[[], float] = time.monotonic
    version: str | None = None
    predict: Predict | None = None
    _checked: float | None = None

    def get(self) -> tuple[Predict, str]:
        now = self.clock()
        if self._checked is None or now - self._checked >= self.every_s:
            self._checked = now
            version = self.current_version()
            if self.predict is None or (version is not None and version != self.version):
                self.predict, self.version = self.load()
        return self.predict, self.version


@dataclass
class LiveJob:
    """Turns feed batches into win-probability points under `root`.

    `games()` reads the games table, `estimates(games)` gives `pregame_prob` per game."""

    spark: SparkSession
    root: str
    model: ModelPointer
    games: Callable[[], DataFrame]
    estimates: Callable[[DataFrame], DataFrame]
    source: str = "live"
    now: Callable[[], datetime] = field(default=lambda: datetime.now(UTC))

    # ------------------------------------------------------------ versioned progress

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, folder: str) -> list[int]:
        path, fs = self._fs()
        base = path(f"{self.root}/{folder}")
        if not fs.exists(base):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(base)]
        numbers = [int(n.split("=")[1]) for n in names if n.startswith("batch=")]
        return sorted(n for n in numbers if fs.exists(path(f"{self.root}/{folder}/batch={n}/_SUCCESS")))

    def _progress_folder(self) -> str:
        return f"progress/{self.source}"

    def _versioned(self, folder: str, schema: str, before: int | None) -> DataFrame:
        known = [v for v in self._versions(folder) if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}/batch={known[-1]}")

    def _save_version(self, folder: str, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{folder}/batch={batch_id}")
        path, fs = self._fs()
        for old in self._versions(folder)[:-KEPT_BATCHES]:
            fs.delete(path(f"{self.root}/{folder}/batch={old}"), True)

    def progress(self, before: int | None = None) -> DataFrame:
        """Open games as of the last committed batch (older than `before`)."""
        return self._versioned(self._progress_folder(), PROGRESS, before)

    def _save_progress(self, rows: DataFrame, batch_id: int) -> None:
        self._save_version(self._progress_folder(), rows, batch_id)

    def waiting(self, before: int | None = None) -> DataFrame:
        """Feed rows of known games that are still scheduled: the newest feed of each."""
        return self._versioned(f"waiting/{self.source}", FEED, before)

    # ------------------------------------------------------------ events

    def tracked(self, events: DataFrame, progress: DataFrame) -> DataFrame:
        """Games of the batch to follow: open ones, and known games that are live now; each with
        its pre-game estimate (the stored one once it is tracked) and last emitted action."""
        final = events.groupBy("game_id").agg(F.bool_or("final").alias("final"))
        starting = self.estimates(
            self.games().where("status = 'live'").join(final.select("game_id"), "game_id", "left_semi")
        ).select("game_id", F.col("pregame_prob").alias("__estimate"))
        open_games = progress.where("NOT finished").select("game_id", "pregame_prob", "last_action_id", "last_prob", "sent")
        done = progress.where("finished").select("game_id")
        joined = final.join(done, "game_id", "left_anti").join(open_games, "game_id", "left").join(starting, "game_id", "left")
        kept = joined.where(F.col("last_action_id").isNotNull() | F.col("__estimate").isNotNull())
        return kept.select(
            "game_id", "final", F.coalesce("pregame_prob", "__estimate").alias("pregame_prob"), "last_action_id", "last_prob", "sent"
        )

    def points(self, events: DataFrame, tracked: DataFrame, predict: Predict) -> DataFrame:
        """New points: states past the last action, the tip-off of a game just started, and the
        final point (exactly 0 or 1) of a game that ended."""
        mine = events.join(tracked.select("game_id"), "game_id", "left_semi")
        latest = latest_by(mine, ["game_id", "action_id"], ["arrival"])
        states = game_states(latest)
        opening = tip_off(tracked.where("last_action_id IS NULL"))
        states = states.unionByName(
            opening.select(*[opening[c].cast(states.schema[c].dataType).alias(c) for c in STATE_COLUMNS])
        )
        ends = states.groupBy("game_id").agg(F.max("action_id").alias("__end"))
        rows = with_times(states).join(tracked, "game_id").join(ends, "game_id")
        last = F.col("action_id") == F.col("__end")
        fresh = F.col("last_action_id").isNull() | (F.col("action_id") > F.col("last_action_id"))
        certain = F.coalesce(F.col("last_prob").isin(0.0, 1.0), F.lit(False))
        closing = F.col("final") & last & (F.col("__end") <= F.col("last_action_id")) & ~certain
        scored = predict(rows.where(fresh | F.coalesce(closing, F.lit(False))).withColumn("__last", last))
        decided = F.col("final") & F.col("__last") & (F.col("score_home") != F.col("score_away"))
        exact = (F.col("score_home") > F.col("score_away")).cast("double")
        return scored.withColumn("home_win_prob", F.when(decided, exact).otherwise(F.col("home_win_prob")))

    def process_events(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of feed rows (for `foreachBatch`)."""
        self._save_progress(self._followed(batch, batch_id), batch_id)

    def _followed(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Write the points of a batch of feed rows and those that waited; the progress after it."""
        predict, version = self.model.get()
        progress = self.progress(before=batch_id)
        columns = [f.split()[0] for f in FEED.split(", ")]
        # A feed holds a game's whole list: the newest one replaces what waited.
        older = self.waiting(before=batch_id).join(batch.select("game_id").distinct(), "game_id", "left_anti")
        events = batch.select(*columns).unionByName(older.select(*columns)).persist()
        tasks = tasks_for(self.spark, events.count(), TASK_ROWS)
        tracked = self.tracked(events, progress).persist()
        try:
            # The batch's plans belong to the stream's own session, the progress table's to ours.
            with shuffles_of(tasks, batch.sparkSession, self.spark):
                emitted = self.points(events, tracked, predict)
                self._write_points(emitted, batch_id, version, tracked.select("game_id", "sent"))
                scheduled = self.games().where("status = 'scheduled'").select("game_id")
                self._save_version(f"waiting/{self.source}", events.join(scheduled, "game_id", "left_semi").select(*columns), batch_id)
                return materialise(self._advance(tracked, progress, batch_id), f"live/{self.source}")
        finally:
            tracked.unpersist()
            events.unpersist()

    def _write_points(self, emitted: DataFrame, batch_id: int, version: str, sent: DataFrame) -> None:
        spread = F.pmod(F.xxhash64("game_id", "action_id"), F.lit(1 << 32))
        rows = emitted.select(
            (F.lit(batch_id).cast("long") * (1 << 32) + spread).alias("id"),
            *POINT,
            F.lit(version).alias("model_version"),
            F.lit(self.now()).alias("created_at"),
        )
        rows.write.mode("overwrite").parquet(self._points_folder(batch_id))
        written = self.spark.read.schema(rows.schema).parquet(self._points_folder(batch_id))
        self._tell(written, changes.POINTS, batch_id, sent)

    def _tell(self, points: DataFrame, kind: str, batch_id: int, sent: DataFrame) -> None:
        """Messages of a batch's points; `sent` (game_id, sent) is each game's message before."""
        told = changes.messages_of(points, kind, changes.sequence(batch_id, kind), self.source, sent)
        told.write.mode("overwrite").json(f"{self.root}/messages/source={self.source}/{kind}={batch_id}")

    def _advance(self, tracked: DataFrame, progress: DataFrame, batch_id: int) -> DataFrame:
        """Progress after the batch: moved games with their newest point. A game without news is
        dropped once the games table has it as final."""
        new = self.spark.read.parquet(self._points_folder(batch_id))
        state = ["period", "clock_seconds", "score_home", "score_away", "possession", "description"]
        newest = latest_by(
            new.select("game_id", "action_id", F.col("home_win_prob").alias("last_prob"), *state), ["game_id"], ["action_id"]
        ).withColumnRenamed("action_id", "last_action_id")
        moved = newest.join(tracked.select("game_id", "pregame_prob", F.col("final").alias("finished")), "game_id")
        moved = moved.withColumn("sent", F.lit(changes.sequence(batch_id, changes.POINTS)))
        ended = tracked.where("final").select("game_id", F.lit(True).alias("ended"))
        closed = self.games().where("status = 'final'").select("game_id", F.lit(True).alias("closed"))
        still = progress.join(moved.select("game_id"), "game_id", "left_anti").join(ended, "game_id", "left").join(closed, "game_id", "left")
        still = still.withColumn("finished", F.col("finished") | F.coalesce("ended", F.lit(False)))
        still = still.where("closed IS NULL")
        columns = [f.split()[0] for f in PROGRESS.split(", ")]
        return still.select(*columns).unionByName(moved.select(*columns))

    def _points_folder(self, batch_id: int) -> str:
        return f"{self.root}/points/source={self.source}/batch={batch_id}"

    # ------------------------------------------------------------ scoreboard

    def known_board(self, board: DataFrame) -> DataFrame:
        return board.join(self.games().select("game_id"), "game_id", "left_semi")

    def closing_points(self, board: DataFrame, progress: DataFrame | None = None) -> DataFrame:
        """Certain final points of open games the board calls finished, from their last state."""
        ended = board.where("status = 'final'").select("game_id")
        progress = self.progress() if progress is None else progress
        rows = progress.where("NOT finished").join(ended, "game_id", "left_semi")
        # A board is read again and again: what it has closed already stays closed.
        certain = self.recorded().groupBy("game_id").agg(F.max_by("home_win_prob", F.struct("action_id", "id")).alias("p"))
        rows = rows.join(certain.where("p IN (0.0, 1.0)").select("game_id"), "game_id", "left_anti")
        undecided = ~rows["last_prob"].isin(0.0, 1.0) & (F.col("score_home") != F.col("score_away"))
        rows = with_times(rows.where(undecided).withColumnRenamed("last_action_id", "action_id"))
        return rows.withColumn("home_win_prob", (F.col("score_home") > F.col("score_away")).cast("double"))

    def open_games(self, board: DataFrame, tables: Tables) -> None:
        """Games that the board calls live or final and the table has as scheduled become live, so
        that their feed is followed; the final status comes after the feed."""
        started = board.where("status IN ('live', 'final')").select("game_id").distinct()
        games = self.games().where("status = 'scheduled'").join(started, "game_id", "left_semi").select("game_id", "season")
        if not games.isEmpty():
            tables.upsert("core.games", games.withColumn("status", F.lit("live")), guard=lambda old, new: old("status") == "scheduled")

    def process_board(self, board: DataFrame, batch_id: int, tables: Tables, progress: DataFrame | None = None) -> None:
        """One scoreboard batch: certain final points of ended games, then status and scores of
        known games in the games table, never of finished ones."""
        newest = latest_by(board, ["game_id"], ["arrival"]) if "arrival" in board.columns else board
        _, version = self.model.get()
        closing = self.closing_points(newest, progress)
        spread = F.pmod(F.xxhash64("game_id", "action_id"), F.lit(1 << 32))
        closing.select(
            (F.lit((1 << 30) + batch_id).cast("long") * (1 << 32) + spread).alias("id"),  # after any batch of events
            *POINT,
            F.lit(version).alias("model_version"),
            F.lit(self.now()).alias("created_at"),
        ).write.mode("overwrite").parquet(self._board_folder(batch_id))
        known = newest.where("status <> 'scheduled'").join(self.games().select("game_id", "season"), "game_id")
        tables.upsert(
            "core.games",
            known.select("game_id", "season", "status", "home_score", "away_score"),
            guard=lambda old, new: old("status") != "final",
        )

    def _board_folder(self, batch_id: int) -> str:
        return f"{self.root}/points/source={self.source}/board={batch_id}"

    def process_poll(self, events: DataFrame, board: DataFrame, batch_id: int, tables: Tables) -> None:
        """One poll: open games, follow the feed, close games, and put the batch's points where
        readers are. Every step may be repeated after a failure; what the table has by then stays."""
        board = board.persist()
        try:
            self.open_games(board, tables)
            progress = self._followed(events, batch_id)
            self.process_board(board, batch_id, tables, progress)
        finally:
            board.unpersist()
        closed = self.spark.read.parquet(self._board_folder(batch_id))
        self._tell(closed, changes.CLOSING, batch_id, progress.select("game_id", "sent"))
        certain = closed.select("game_id", F.col("home_win_prob").alias("__certain"))
        settled = progress.join(certain, "game_id", "left")
        last = F.when(F.col("__certain").isNotNull(), F.lit(changes.sequence(batch_id, changes.CLOSING))).otherwise(F.col("sent"))
        settled = settled.withColumn("sent", last).withColumn("last_prob", F.coalesce("__certain", "last_prob"))
        new = self.spark.read.schema(closed.schema).parquet(self._points_folder(batch_id)).unionByName(closed)
        self.store(tables, latest_by(new, ["game_id", "action_id"], ["id"]))
        tables.compact(SNAPSHOTS)
        self._save_progress(settled.drop("__certain"), batch_id)
        self.forget(batch_id)

    def store(self, tables: Tables, points: DataFrame, replace: bool = False) -> None:
        """Put points into the table that readers, monitoring and pruning use. A point of the same
        action gives way to the newer one; with `replace` all older points of the games and source
        do. Only the shards of these games are rewritten, and the same points again change nothing;
        points that were pruned since do not come back."""
        shard = F.concat_ws("-", F.lit(self.source), F.pmod(F.xxhash64("game_id"), F.lit(SHARDS)).cast("string"))
        new = tables.conform(SNAPSHOTS, points.withColumn("source", F.lit(self.source)).withColumn("shard", shard))
        new = materialise(new, f"live/{self.source}")
        touched = [r[0] for r in new.select("shard").distinct().collect()]  # at most `SHARDS`
        if not touched:
            return
        old = tables.read(SNAPSHOTS).where(F.col("shard").isin(touched))
        if replace:
            old = old.join(new.select("game_id").distinct(), "game_id", "left_anti").select(*new.columns)
        merged = latest_by(old.unionByName(new), ["game_id", "source", "action_id"], ["id"])
        tables.replace_partitions(SNAPSHOTS, merged.repartition("shard"))

    def forget(self, batch_id: int) -> None:
        """Delete recorded points of batches that are in the table for long."""
        path, fs = self._fs()
        folder = path(f"{self.root}/points/source={self.source}")
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            kind, _, number = status.getPath().getName().partition("=")
            if kind in ("batch", "board") and int(number) <= batch_id - KEPT_BATCHES:
                fs.delete(status.getPath(), True)

    def update_games(self, games: DataFrame, board: DataFrame) -> DataFrame:
        """Games with status and scores from the newest board rows; finished games stay."""
        newest = latest_by(board, ["game_id"], ["arrival"]) if "arrival" in board.columns else board
        return update_from_scoreboard(games, newest)

    # ------------------------------------------------------------ reading back

    def recorded(self) -> DataFrame:
        """All points of this source, newest per action (X13's consumer merge)."""
        schema = (
            "id long, game_id string, action_id long, period int, clock_seconds double, elapsed_seconds double, "
            "score_home int, score_away int, possession int, home_win_prob double, description string, "
            "model_version string, created_at timestamp"
        )
        path, fs = self._fs()
        folder = f"{self.root}/points/source={self.source}"
        if not fs.exists(path(folder)):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
        tasks = tasks_for(self.spark, rows.count(), TASK_ROWS)
        return latest_by(dealt(rows, tasks, "game_id", "action_id"), ["game_id", "action_id"], ["id"])

    def messages(self) -> DataFrame:
        """The change log so far: see `changes`."""
        return self.spark.read.schema(changes.MESSAGE).option("recursiveFileLookup", "true").json(f"{self.root}/messages")

    def snapshot(self, points: DataFrame) -> DataFrame:
        """A snapshot message for every game of a series (`points` of this source as stored), with
        the message up to which it is complete."""
        sent = self.progress().select("game_id", "sent")
        return changes.snapshot_of(points.where(F.col("source") == self.source), self.source, sent)

    # ------------------------------------------------------------ running

    def start(self, feed: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = feed.writeStream.foreachBatch(self.process_events).option("checkpointLocation", checkpoint)
        if available_now:
            return writer.trigger(availableNow=True).start()
        return writer.trigger(processingTime=f"{EVENTS_SECONDS} seconds").start()

    def replay(self, events: DataFrame) -> DataFrame:
        """Run finished games' stored events through the live path as one final poll. The games'
        earlier replay is replaced (one batch folder per set of games), so a second run leaves
        the same points."""
        feed = events.withColumn("final", F.lit(True)).withColumn("arrival", F.lit(0).cast("long"))
        predict, version = self.model.get()
        games = feed.select("game_id").distinct()
        finals = self.games().join(games, "game_id", "left_semi")
        tracked = self.estimates(finals).select(
            "game_id",
            F.lit(True).alias("final"),
            "pregame_prob",
            F.lit(None).cast("long").alias("last_action_id"),
            F.lit(None).cast("double").alias("last_prob"),
        )
        told = self.reset(games)
        batch_id = max([*self._versions(f"points/source={self.source}"), -1]) + 1
        with shuffles_of(tasks_for(self.spark, feed.count(), TASK_ROWS), feed.sparkSession, self.spark):
            self._write_points(self.points(feed, tracked, predict), batch_id, version, games.withColumn("sent", F.lit(told)))
        return self.recorded()

    def reset(self, games: DataFrame) -> int:
        """Drop the recorded points of `games` under this source and tell subscribers; the number of
        that message."""
        kept = self._versions(f"points/source={self.source}")
        if kept:
            rows = self.recorded().join(games, "game_id", "left_anti")
            target = kept[-1] + 1
            rows.write.mode("overwrite").parquet(self._points_folder(target))
            path, fs = self._fs()
            for old in kept:
                fs.delete(path(self._points_folder(old)), True)
        stamp = max([*kept, -1]) + 1
        number = changes.sequence(stamp, changes.RESET)
        changes.resets_of(games, number, self.source).write.mode("overwrite").json(
            f"{self.root}/messages/source={self.source}/{changes.RESET}={stamp}"
        )
        return number


def feed_rows(docs: DataFrame) -> DataFrame:
    """Landed play-by-play documents as feed rows: the newest document of each game. The feed does
    not say when a game has ended; the scoreboard closes it."""
    rows = stats_feed.parse_play_by_play(docs)
    columns = [f.split()[0] for f in FEED.split(", ")]
    return rows.withColumn("final", F.lit(False)).withColumn("arrival", F.lit(0).cast("long")).select(*columns)


def board_rows(docs: DataFrame) -> DataFrame:
    """Landed scoreboards as board rows; of several, a game's newest counts."""
    rows = stats_feed.parse_scoreboard(docs)
    return rows.select("game_id", "status", "home_score", "away_score", "tip_time_utc", "arrival")


def joint_polls(events: DataFrame, boards: DataFrame) -> DataFrame:
    """Streams of feed and board documents as one, so that a batch holds both in a known order."""
    tagged = events.select(F.struct("*").alias("feed"))
    return tagged.unionByName(boards.select(F.struct("*").alias("board")), allowMissingColumns=True)


def split_polls(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feed documents and board documents of a batch."""
    return docs.where("feed IS NOT NULL").select("feed.*"), docs.where("board IS NOT NULL").select("board.*")


def read_feed(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Landed feed polls as a stream. Every file holds the whole feed of its games."""
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_documents(
    docs: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every_s: int, available_now: bool = False
) -> StreamingQuery:
    """Apply a function to each micro-batch of landed documents."""
    writer = docs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{every_s} seconds").start()


def table_pending(games: DataFrame, now: datetime) -> bool:
    """Is a game of the table live, or due to start soon?"""
    soon = F.col("tip_time_utc").between(F.lit(now - PENDING_WITHIN), F.lit(now + PENDING_WITHIN))
    return not games.where((F.col("status") == "live") | ((F.col("status") == "scheduled") & soon)).isEmpty()


def games_pending(board: DataFrame, games: DataFrame, now: datetime) -> bool:
    """Is a known game on the board live, or due to start soon (or without a start time)?"""
    known = board.join(games.select("game_id"), "game_id", "left_semi")
    soon = F.col("tip_time_utc").isNull() | (F.col("tip_time_utc") <= F.lit(now + PENDING_WITHIN))
    waiting = (F.col("status") == "live") | ((F.col("status") == "scheduled") & soon)
    return not known.where(waiting).isEmpty()


def run_until(
    queries: list[StreamingQuery],
    idle: Callable[[], bool],
    max_seconds: float | None = None,
    check_s: float = SCOREBOARD_SECONDS,
    clock: Callable[[], float] = time.monotonic,
) -> str:
    """Keep the queries running until nothing is pending or the time limit is reached."""
    started = clock()
    while True:
        if idle():
            reason = "idle"
            break
        if max_seconds is not None and clock() - started >= max_seconds:
            reason = "time limit"
            break
        queries[0].awaitTermination(check_s)
        failed = [q for q in queries if not q.isActive and q.exception() is not None]
        if failed:  # one dead stream ends the run, whichever it is
            for q in queries:
                q.stop()
            raise failed[0].exception()
        if not any(q.isActive for q in queries):
            reason = "ended"
            break
    for q in queries:
        q.stop()
    return reason
