"""Model versions and the production pointer."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from boutline.operators.boosting import Booster
from boutline.plans import rules
from boutline.plans.ingame import InGameModel
from boutline.plans.pregame import PregameModel
from boutline.sources.tables import Tables

PREGAME, INGAME = "pregame", "ingame"
TABLE = "serving.registered_models"


@dataclass
class Registration:
    name: str
    version: int
    promoted: bool
    reason: str


def _save(spark: SparkSession, model: PregameModel | InGameModel, path: str) -> dict[str, str]:
    """Write the model's folders; what is not in them goes into string parameters."""
    stored = spark.createDataFrame([(json.dumps(model.booster.as_dict()),)], "booster string")
    stored.write.mode("overwrite").parquet(f"{path}/booster")
    kept = {"train_seasons": json.dumps(model.train_seasons)}
    if isinstance(model, PregameModel):
        kept |= {
            "feature_version": model.feature_version,
            "calibration": model.calibration,
            "calibration_season": json.dumps(model.calibration_season),
        }
        if model.calibrator is not None:
            model.calibrator.write().overwrite().save(f"{path}/calibrator")
    return kept


def _open(spark: SparkSession, row: Row) -> PregameModel | InGameModel:
    params = row["params"]
    booster = Booster.from_dict(json.loads(spark.read.parquet(f"{row['path']}/booster").first()[0]))
    seasons = json.loads(params["train_seasons"])
    if row["name"] == INGAME:
        return InGameModel(booster, seasons)
    calibrator = None
    if params["calibration"] == "isotonic":
        calibrator = IsotonicRegressionModel.load(f"{row['path']}/calibrator")
    return PregameModel(
        booster,
        calibrator,
        params["feature_version"],
        seasons,
        json.loads(params["calibration_season"]),
    )


def _row(tables: Tables, condition: F.Column) -> Row | None:
    return tables.read(TABLE).where(condition).orderBy(F.desc("version")).first()


def _store(tables: Tables, row: dict[str, Any], promote: bool) -> None:
    """Insert or replace one version; a promoted one demotes the others of its name."""
    schema = tables.schema(TABLE)
    fresh = tables.spark.createDataFrame([tuple(row[f] for f in schema.fieldNames())], schema)
    same = (F.col("name") == row["name"]) & (F.col("version") == row["version"])
    old = tables.read(TABLE).where(~same)
    if promote:
        old = old.withColumn("is_production", F.col("is_production") & (F.col("name") != row["name"]))
    tables.replace(TABLE, old.unionByName(fresh))


def register(
    tables: Tables,
    name: str,
    model: PregameModel | InGameModel,
    season: int,
    logloss: float,
    acceptance: dict[str, bool],
    now: datetime,
    params: dict[str, Any] | None = None,
    metrics: dict[str, float] | None = None,
    artifacts: dict[str, Any] | None = None,
    tags: dict[str, str] | None = None,
) -> Registration:
    """Store a new version and promote it if the promotion rule says so. Log losses are tagged
    with full precision, so an identical score never counts as better."""
    spark = tables.spark
    failed = [k for k, ok in acceptance.items() if not ok]
    candidate = spark.createDataFrame(
        [(name, season, logloss, failed)], "name string, season int, logloss double, failed array<string>"
    )
    production = tables.read(TABLE).where(F.col("is_production"))
    decision = rules.promotion(candidate, production).first()
    latest = tables.read(TABLE).where(F.col("name") == name).agg(F.max("version")).first()[0]
    version = (latest or 0) + 1
    path = f"{tables.root}/models/{name}/{version}"
    kept = _save(spark, model, path)
    row = {
        "name": name,
        "version": version,
        "path": path,
        "params": {k: str(v) for k, v in (params or {}).items()} | kept,
        "metrics": {k: float(v) for k, v in (metrics or {}).items()},
        "artifacts": {k: json.dumps(v) for k, v in (artifacts or {}).items()}
        | {"importance.json": json.dumps(model.importance())},
        "tags": {f"{rules.TAG_PREFIX}{season}": repr(logloss), **(tags or {}), "promotion": decision["reason"]},
        "is_production": bool(decision["promote"]),
        "created_at": now,
    }
    _store(tables, row, row["is_production"])
    return Registration(name, version, row["is_production"], decision["reason"])


def production_version(tables: Tables, name: str) -> int | None:
    row = _row(tables, (F.col("name") == name) & F.col("is_production"))
    return None if row is None else row["version"]


def load_production(tables: Tables, name: str) -> tuple[PregameModel | InGameModel, str]:
    """The production model with its version, both from one registry row."""
    row = _row(tables, (F.col("name") == name) & F.col("is_production"))
    if row is None:
        raise LookupError(f"no production {name} model registered")
    return _open(tables.spark, row), str(row["version"])


def version_details(tables: Tables, name: str, version: int) -> Row:
    row = _row(tables, (F.col("name") == name) & (F.col("version") == version))
    if row is None:
        raise LookupError(f"no {name} version {version}")
    return row


def heldout(tables: Tables, name: str) -> DataFrame:
    """(model, model_version, logloss) of every version of `name`, for the monitor."""
    rows = tables.read(TABLE).where(F.col("name") == name)
    return rows.select(
        F.col("name").alias("model"),
        F.col("version").cast("string").alias("model_version"),
        rules.heldout_logloss(F.col("tags")).alias("logloss"),
    )


def pooled_expected(tables: Tables) -> DataFrame:
    """A pre-game version's pooled walk-forward log loss, from its stored report."""
    return tables.read("serving.model_versions").select(
        F.lit(PREGAME).alias("model"),
        F.col("version").alias("model_version"),
        F.get_json_object("backtest", "$.pooled_model.logloss").try_cast("double").alias("logloss"),
    )


def snapshot_version(tables: Tables, version: str, now: datetime) -> None:
    """Copy a used version's report out of the registry, once."""
    row = version_details(tables, PREGAME, int(version))
    used = tables.spark.createDataFrame(
        [
            (
                version,
                f"{row['name']}:{row['version']}",
                row["params"]["feature_version"],
                row["params"]["calibration"],
                row["params"]["train_seasons"],
                row["artifacts"].get("backtest.json"),
                json.loads(row["artifacts"]["importance.json"]),
                now,
            )
        ],
        tables.schema("serving.model_versions"),
    )
    tables.append("serving.model_versions", rules.snapshot_versions(used, tables.read("serving.model_versions")))


def copy_production(source: Tables, target: Tables, name: str) -> int:
    """Copy a production version into another registry, keeping its number."""
    version = production_version(source, name)
    if version is None:
        raise LookupError(f"no production {name} model registered")
    row = version_details(source, name, version).asDict()
    model = _open(source.spark, version_details(source, name, version))
    row["path"] = f"{target.root}/models/{name}/{version}"
    _save(target.spark, model, row["path"])
    row["is_production"] = True
    _store(target, row, True)
    return version
