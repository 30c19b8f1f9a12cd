"""Registration of queries over the fixture league."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boutline.fixtures import League, league
from boutline.oracle import with_views
from boutline.session import COMPILED_BYTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
NUDGE = 1e-10  # keeps exact halves from rounding differently in different engines
WHOLE = ("tinyint", "smallint", "int")


def settled(df: DataFrame) -> DataFrame:
    """Doubles to six digits and integers to long, so results compare across engines."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append(f"round(`{name}` + CAST({NUDGE} AS DOUBLE), {DIGITS}) + 0D AS `{name}`")
        elif kind in WHOLE:
            out.append(f"CAST(`{name}` AS BIGINT) AS `{name}`")
        else:
            out.append(f"`{name}`")
    return df.selectExpr(*out)


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query; `doubles` names the columns the SQL side rounds alike."""

    def register(build: Callable[[League], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for key, value in {"spark.sql.session.timeZone": "UTC", **COMPILED_BYTES}.items():
                spark.conf.set(key, value)
            return settled(build(league(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            names = doubles.split()
            rounded = ", ".join(f"round({c} + {NUDGE}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS {c}" for c in names)
            body = f"SELECT * REPLACE ({rounded}) FROM (\n{sql}\n)" if names else sql
            ORACLES[name] = with_views(body)
        return build

    return register
