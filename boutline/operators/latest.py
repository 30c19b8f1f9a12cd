"""Latest / first row per key by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str], first: bool = False) -> DataFrame:
    """One row per key: the one greatest (or least) in `order`.

    An aggregate, not a ranking window: each task reduces its own rows before the shuffle, so a
    hot key costs one row per task."""
    pick = F.min_by if first else F.max_by
    rest = [c for c in df.columns if c not in keys]
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("__row")).select(*keys, "__row.*")


def attach_latest(
    left: DataFrame, right: DataFrame, keys: list[str], order: list[str], columns: list[str], prefix: str = ""
) -> DataFrame:
    """Left join the latest right row per key (a lateral top-1)."""
    narrow = latest_by(right.select(*dict.fromkeys([*keys, *order, *columns])), keys, order)
    return left.join(narrow.select(*keys, *[F.col(c).alias(prefix + c) for c in columns]), keys, "left")
