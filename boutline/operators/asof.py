"""Backward as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.operators.running import running


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    on: str,
    values: list[str],
    allow_exact: bool = False,
    chunk: Column | None = None,
) -> DataFrame:
    """For each left row, `values` of the latest right row with `right.on < left.on` per `by`.

    One pass over the union of both sides ordered by `on` (no range join): the last right row
    seen is carried forward, chunk by chunk. Right rows must be unique per (by, on). `on` must
    be an integer or date column present on both sides; `chunk` defaults to stretches of 64
    days."""
    side = F.lit(0 if allow_exact else 1)
    day = F.unix_date(on) if dict(left.dtypes)[on] == "date" else F.col(on)
    tagged_left = left.select(
        *left.columns,
        F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("__state"),
        F.lit(1 - (0 if allow_exact else 1)).alias("__side"),
    )
    tagged_right = right.select(*by, on, F.struct(*values).alias("__state"), side.alias("__side"))
    both = tagged_left.withColumn("__left", F.lit(True)).unionByName(
        tagged_right.withColumn("__left", F.lit(False)), allowMissingColumns=True
    )
    both = both.withColumn("__on", day)
    carried = running(
        both,
        by,
        F.floor(F.col("__on") / 64) if chunk is None else chunk,
        ["__on", "__side"],
        lasts={"__state": F.col("__state")},
    )
    return carried.where("__left").select(*left.columns, *[F.col(f"__state.{v}").alias(v) for v in values])
