"""Stored tables: Parquet folders with versions, keyed merges and partition rewrites."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boutline.operators.upsert import upsert
from boutline.session import materialise

# Table name -> (columns, key, partition columns).
TABLES: dict[str, tuple[str, list[str], list[str]]] = {
    "raw.api_responses": (
        "request_key string, source string, endpoint string, params map<string,string>, subject string, document string, "
        "fetched_at timestamp, bytes long, checksum string, payload string, slot string",
        ["document", "fetched_at"],
        ["slot"],
    ),
    "raw.loaded_documents": (
        "document string, fetched_at timestamp, loaded_at timestamp, slot string",
        ["document", "fetched_at"],
        ["slot"],
    ),
    "raw.ingestion_runs": (
        "task_key string, status string, attempts int, rows long, error string, updated_at timestamp",
        ["task_key"],
        [],
    ),
    "raw.rejects": (
        "kind string, subject string, reason string, rejected_at timestamp",
        ["kind", "subject", "rejected_at"],
        [],
    ),
    "core.teams": (
        "team_id long, abbreviation string, city string, nickname string, full_name string",
        ["team_id"],
        [],
    ),
    "core.games": (
        "game_id string, season int, season_type string, game_date date, tip_time_utc timestamp, home_team_id long, "
        "away_team_id long, status string, home_score int, away_score int, is_neutral boolean, provider_id string",
        ["game_id"],
        ["season"],
    ),
    "core.team_game_stats": (
        "game_id string, team_id long, is_home boolean, minutes int, pts int, fgm int, fga int, fg3m int, fg3a int, "
        "ftm int, fta int, oreb int, dreb int, reb int, ast int, stl int, blk int, tov int, pf int, plus_minus int, season int",
        ["game_id", "team_id"],
        ["season"],
    ),
    "core.pbp_events": (
        "game_id string, action_id long, action_number long, period int, clock_seconds double, team_id long, "
        "location string, person_id long, action_type string, sub_type string, description string, "
        "is_field_goal boolean, shot_value int, shot_result string, score_home int, score_away int, season int",
        ["game_id", "action_id"],
        ["season"],
    ),
    "features.game_features": (
        "game_id string, feature_version string, features string, season int",
        ["game_id"],
        ["season"],
    ),
    "features.feature_inputs": (
        "game_id string, game_date date, home_team_id long, away_team_id long, digest string, season int",
        ["game_id"],
        ["season"],
    ),
    "features.elo_ratings": (
        "game_id string, game_date date, team_id long, elo_pre double, elo_post double, season int",
        ["game_id", "team_id"],
        ["season"],
    ),
    "features.rating_inputs": (
        "game_id string, game_date date, season int, digest string",
        ["game_id"],
        [],
    ),
    "serving.model_versions": (
        "version string, run_id string, feature_version string, calibration string, train_seasons string, "
        "backtest string, importance map<string,double>, first_used_at timestamp",
        ["version"],
        [],
    ),
    "serving.predictions": (
        "id long, game_id string, model_version string, feature_version string, home_win_prob double, "
        "factors array<struct<feature:string,value:double,contribution:double>>, made_before_tip boolean, created_at timestamp",
        ["id"],
        [],
    ),
    "serving.live_wp_snapshots": (
        "id long, game_id string, model_version string, action_id long, period int, clock_seconds double, "
        "elapsed_seconds double, score_home int, score_away int, possession int, home_win_prob double, "
        "description string, created_at timestamp, source string, shard string",
        ["id"],
        ["shard"],
    ),
    "serving.monitoring_runs": (
        "id long, run_at timestamp, model string, window string, model_version string, games long, logloss double, "
        "brier double, accuracy double, ece double, expected_logloss double, status string, message string",
        ["id"],
        [],
    ),
    "serving.job_runs": (
        "id string, job string, started_at timestamp, finished_at timestamp, status string, detail string",
        ["id"],
        [],
    ),
    "serving.registered_models": (
        "name string, version int, path string, params map<string,string>, metrics map<string,double>, "
        "artifacts map<string,string>, tags map<string,string>, is_production boolean, created_at timestamp",
        ["name", "version"],
        [],
    ),
}


# Bytes up to which a merge rewrites a partition whole: about a file's worth.
SMALL_PARTITION = 64 << 20


class Tables:
    """Tables under one root folder, each a list of immutable Parquet commits.

    A commit is a folder `commit=<n>-<kind>`: `full` is the whole table, `part` replaces the
    partitions it holds, `add` adds rows, `merge` adds rows in place of the files that `removed-<n>`
    beside it lists. Readers resolve the commits whose marker exists when
    they plan, so they never see a half-written table, and files a running job reads are never
    rewritten under it. `vacuum` removes what the newest full commit replaced."""

    def __init__(self, spark: SparkSession, root: str, release: dict[str, int] | None = None):
        self.spark, self.root, self.release = spark, root.rstrip("/"), release
        self.small_partition = SMALL_PARTITION
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def schema(self, name: str) -> StructType:
        return StructType.fromDDL(TABLES[name][0])

    # ------------------------------------------------------------ commits

    def _folder(self, name: str) -> str:
        return f"{self.root}/{name.replace('.', '/')}"

    def _list(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _commits(self, name: str) -> list[tuple[int, str]]:
        """Committed (number, kind), oldest first, from the newest full commit on."""
        out = []
        for entry in self._list(self._folder(name)):
            if entry.startswith("commit=") and self._fs.exists(self._path(f"{self._folder(name)}/{entry}/_SUCCESS")):
                number, kind = entry.removeprefix("commit=").split("-")
                if self.release is not None and int(number) > self.release.get(name, 0):
                    break
                out = [(int(number), kind)] if kind == "full" else [*out, (int(number), kind)]
        return out

    def version(self, name: str) -> int:
        """Number of the newest commit, 0 if the table was never written."""
        commits = self._commits(name)
        return commits[-1][0] if commits else 0

    def _commit_folder(self, name: str, number: int, kind: str) -> str:
        return f"{self._folder(name)}/commit={number:08d}-{kind}"

    def _current_paths(self, name: str) -> list[str]:
        """Folders that make up the table now; per partition value when it is partitioned."""
        folders = [(kind, self._commit_folder(name, number, kind)) for number, kind in self._commits(name)]
        if not TABLES[name][2]:
            return [folder for _, folder in folders]
        current: dict[str, list[str]] = {}
        for kind, folder in folders:
            for value in (v for v in self._list(folder) if "=" in v):
                kept = current.get(value, []) if kind in ("add", "merge") else []
                current[value] = [*kept, f"{folder}/{value}"]
        removed = self._removed(name)
        whole = {file.rsplit("/", 1)[0] for file in removed}
        paths = [path for paths in current.values() for path in paths]
        # Folders of which some files were replaced are given file by file.
        files = [f"{p}/{f}" for p in paths if p in whole for f in self._list(p) if f[0] not in "._"]
        return [p for p in paths if p not in whole] + [f for f in files if f not in removed]

    def _removed(self, name: str) -> set[str]:
        """Files that merges have replaced since the newest full commit."""
        out = set()
        for number, kind in self._commits(name):
            # A vacuum that has deleted the files drops their list.
            if kind == "merge" and self._fs.exists(self._path(self._removed_list(name, number))):
                lines = self._read_text(self._removed_list(name, number)).splitlines()
                out |= {f"{self._folder(name)}/{line}" for line in lines}
        return out

    def _read_text(self, file: str) -> str:
        stream = self._fs.open(self._path(file))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, file: str, text: str) -> None:
        stream = self._fs.create(self._path(file), True)
        stream.write(bytearray(text, "utf-8"))
        stream.close()

    def _removed_list(self, name: str, number: int) -> str:
        return f"{self._folder(name)}/removed-{number:08d}"

    def _commit(self, name: str, df: DataFrame, kind: str, removed: list[str] | None = None) -> None:
        if self.release is not None:
            raise RuntimeError("tables of a release cannot be written")
        taken = [int(e[7:].split("-")[0]) for e in self._list(self._folder(name)) if e.startswith("commit=")]
        number = max([0, *taken]) + 1
        if kind == "merge":
            # Before the rows: the list counts only once the commit does.
            self._write_text(self._removed_list(name, number), "\n".join(removed or []))
        writer = self.conform(name, df).write.mode("errorifexists")
        if TABLES[name][2]:
            writer = writer.partitionBy(*TABLES[name][2])
        writer.parquet(self._commit_folder(name, number, kind))

    def vacuum(self, name: str) -> None:
        """Delete what no read of the table can reach any more: commits before the newest full one,
        and partitions and files that later commits replaced (run it while no older reader is active).
        A table written since the newest release keeps all, since readers of the release need it."""
        commits = self._commits(name)
        released = self.newest_release()
        if self.release is not None or (released is not None and commits and commits[-1][0] > released[1].get(name, 0)):
            return
        first = commits[0][0] if commits and commits[0][1] == "full" else 0
        removed = self._removed(name)
        current = set(self._current_paths(name))
        current |= {path.rsplit("/", 1)[0] for path in current}
        for file in removed:
            self._fs.delete(self._path(file), False)
        newest = commits[-1][0] if commits else 0
        for entry in self._list(self._folder(name)):
            if entry.startswith("removed-") and int(entry[8:]) <= newest:
                self._fs.delete(self._path(f"{self._folder(name)}/{entry}"), False)
            if not entry.startswith("commit="):
                continue
            number, kind = entry.removeprefix("commit=").split("-")
            folder = self._commit_folder(name, int(number), kind)
            if int(number) < first:
                self._fs.delete(self._path(folder), True)
            elif TABLES[name][2] and (int(number), kind) in commits:
                for value in (v for v in self._list(folder) if "=" in v):
                    if f"{folder}/{value}" not in current:
                        self._fs.delete(self._path(f"{folder}/{value}"), True)

    # ------------------------------------------------------------ reads and writes

    def read(self, name: str) -> DataFrame:
        schema, paths = self.schema(name), self._current_paths(name)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self._scan(name, paths).select(*schema.fieldNames())

    def _scan(self, name: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema(name)).option("basePath", self._folder(name)).parquet(*paths)

    def conform(self, name: str, df: DataFrame) -> DataFrame:
        """Cast to the table's columns; columns the rows lack become NULL."""
        have = set(df.columns)
        return df.select(
            *[
                (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in self.schema(name).fields
            ]
        )

    def replace(self, name: str, df: DataFrame) -> None:
        """Replace the whole table in one commit."""
        self._commit(name, df, "full")

    def replace_partitions(self, name: str, df: DataFrame) -> None:
        """Replace just the partitions that `df` holds in one commit."""
        self._commit(name, df, "part")

    def append(self, name: str, df: DataFrame) -> None:
        self._commit(name, df, "add")

    def upsert(self, name: str, new: DataFrame, guard: Callable | None = None, update: dict | None = None) -> None:
        """Merge rows by key. A partitioned table rewrites only the files that hold one of the keys, or a
        whole partition of at most `small_partition` bytes, so that small files do not pile up (a row's
        partition must not change); any other table is replaced. The rows are computed once; keys
        that come twice are refused, since either row could win."""
        _, keys, partitions = TABLES[name]
        types = {f.name: f.dataType for f in self.schema(name).fields}
        new = materialise(new.select(*[F.col(c).cast(types[c]).alias(c) for c in new.columns if c in types]), f"upsert/{name}")
        twice = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys).limit(3).collect()
        if twice:
            raise ValueError(f"{name}: rows to merge repeat keys, such as {[tuple(r) for r in twice]}")
        if not partitions:
            return self.replace(name, upsert(self.read(name), new, keys, guard, update))
        # One row a touched partition (season): bounded by the number of partitions.
        bounds = [f(c).alias(f"{f.__name__}_{c}") for c in keys for f in (F.min, F.max)]
        spans = [r.asDict() for r in new.groupBy(*partitions).agg(*bounds).collect()]
        pieces = self._pieces(name)
        within = {str(span[partitions[0]]): pieces.get(str(span[partitions[0]]), {}) for span in spans}
        large = {value for value, files in within.items() if sum(files.values()) > self.small_partition}
        touched = {file for value, files in within.items() if value not in large for file in files}
        touched |= self._files_with(name, new, [s for s in spans if str(s[partitions[0]]) in large])
        schema = self.schema(name)
        old = self._scan(name, sorted(touched)).select(*schema.fieldNames()) if touched else self.spark.createDataFrame([], schema)
        rows = upsert(old, new, keys + partitions, guard, update)
        # Sorted by key, so that files hold narrow key ranges and later merges skip most by their statistics.
        rows = rows.repartitionByRange(*partitions, *keys).sortWithinPartitions(*partitions, *keys)
        if touched == {file for files in within.values() for file in files}:
            return self._commit(name, rows, "part")
        below = len(self._folder(name)) + 1
        self._commit(name, rows, "merge", sorted(file[below:] for file in touched))

    def _pieces(self, name: str) -> dict[str, dict[str, int]]:
        """Bytes of each file, per partition value."""
        out: dict[str, dict[str, int]] = {}
        below = len(self._folder(name)) + 1
        for path in self._current_paths(name):
            value = unquote(path[below:].split("/")[1].split("=", 1)[1])
            value = "None" if value == "__HIVE_DEFAULT_PARTITION__" else value
            for status in self._fs.listStatus(self._path(path)):
                file = status.getPath().getName()
                if file[0] not in "._":
                    folder = path.rsplit("/", 1)[0] if path.endswith(f"/{file}") else path
                    out.setdefault(value, {})[f"{folder}/{file}"] = status.getLen()
        return out

    def _files_with(self, name: str, new: DataFrame, spans: list[dict]) -> set[str]:
        """The table's files that hold a key of `new`. Only key columns are read, of the partitions of
        `spans`, and no row group whose statistics lie outside the keys' range there."""
        _, keys, partitions = TABLES[name]
        if not spans:
            return set()
        reach = F.lit(False)
        for span in spans:
            inside = F.col(partitions[0]).eqNullSafe(F.lit(span[partitions[0]]))
            for c in keys:
                inside = inside & F.col(c).between(F.lit(span[f"min_{c}"]), F.lit(span[f"max_{c}"]))
            reach = reach | inside
        held = self._scan(name, self._current_paths(name)).where(reach)
        held = held.select(*partitions, *keys, F.col("_metadata.file_path").alias("__file"))
        found = held.join(new.select(*partitions, *keys), partitions + keys, "left_semi").select("__file").distinct()
        root = self._folder(name)
        # Folder and file below the table's: commit, partition, file.
        return {f"{root}/{'/'.join(unquote(r[0]).split('/')[-3:])}" for r in found.collect()}

    def compact_partitions(self, name: str, most: int = 64) -> list[str]:
        """Rewrite the partitions that merges have left in more than `most` pieces; they are returned."""
        pieces: dict[str, int] = {}
        for path in self._current_paths(name):
            value = path[len(self._folder(name)) + 1 :].split("/")[1]
            pieces[value] = pieces.get(value, 0) + 1
        many = sorted(v for v, n in pieces.items() if n > most)
        if many:
            (column,) = TABLES[name][2]
            rows = self.read(name).where(F.col(column).cast("string").isin([unquote(v.split("=", 1)[1]) for v in many]))
            spread = f"SELECT /*+ REBALANCE({column}) */ * FROM {{t}}"
            keys = TABLES[name][1]
            self.replace_partitions(name, self.spark.sql(spread, t=rows).sortWithinPartitions(column, *keys))
        return many

    def compact(self, name: str, most: int = 64) -> bool:
        """Put a partitioned table of more than `most` commits into one, a file or few a partition; a
        large partition is split over tasks."""
        if len(self._commits(name)) <= most:
            return False
        spread = f"SELECT /*+ REBALANCE({', '.join(TABLES[name][2])}) */ * FROM {{t}}"
        self.replace(name, self.spark.sql(spread, t=self.read(name)))
        return True

    def rewrite(self, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the table by a function of itself (deletes, thinning)."""
        self.replace(name, change(self.read(name)))

    # ------------------------------------------------------------ releases

    def newest_release(self) -> tuple[int, dict[str, int]] | None:
        """Number of the newest release and the commit it names of every table; None without any."""
        done = [e for e in self._list(f"{self.root}/releases") if e.startswith("release-")]
        if not done:
            return None
        return int(done[-1][8:]), json.loads(self._read_text(f"{self.root}/releases/{done[-1]}"))

    def make_release(self) -> int:
        """Name the newest commit of every table as one version of them all. The file appears whole, by
        a rename, so readers have all tables as they were or all as they are."""
        last = self.newest_release()
        number = last[0] + 1 if last else 1
        commits = {name: v for name in TABLES if (v := self.version(name))}
        pending, final = (f"{self.root}/releases/{p}-{number:08d}" for p in ("pending", "release"))
        self._write_text(pending, json.dumps(commits))
        if not self._fs.rename(self._path(pending), self._path(final)):
            raise RuntimeError(f"release {number} was made by another writer")
        return number

    def released(self) -> Tables:
        """The tables as the newest release names them, whatever is written after it; as they are now
        where no release was made. Such tables cannot be written."""
        last = self.newest_release()
        return self if last is None else Tables(self.spark, self.root, last[1])

    # ------------------------------------------------------------ copies

    def copy_to(self, target: Tables, names: Iterable[str]) -> dict[str, int]:
        """Replace the listed tables of `target`; rows are counted while they are written."""
        counts = {}
        for name in names:
            seen = Observation(name)
            target.replace(name, self.read(name).observe(seen, F.count(F.lit(1)).alias("rows")))
            counts[name] = int(seen.get["rows"])
        return counts


# What readers and scoring need; events and raw responses stay behind.
PUBLISHED = [
    "core.teams",
    "core.games",
    "core.team_game_stats",
    "features.elo_ratings",
    "features.game_features",
    "serving.model_versions",
    "serving.predictions",
    "serving.live_wp_snapshots",
    "serving.monitoring_runs",
    "serving.job_runs",
    "serving.registered_models",
]
