"""Running sums and carried-forward values that stay parallel inside one hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.session import materialise

CHUNK_ROWS = 65_536


def running(
    df: DataFrame,
    keys: list[str],
    chunk: Column,
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums (`sums`) and last non-null values (`lasts`) per `keys` in `order`.

    `chunk` cuts each key's rows into consecutive stretches (it must not decrease along
    `order`). Rows are shuffled by (keys, chunk), so a key holding a third of the table still
    spreads over many tasks; only one summary row per chunk is ordered per whole key, and its
    prefix is joined back as the chunk's starting value. `inclusive=False` leaves the current
    row out of its own result."""
    sums, lasts = sums or {}, lasts or {}
    staged = df.withColumn("__chunk", chunk)
    for name, expr in {**sums, **lasts}.items():
        staged = staged.withColumn(f"__in_{name}", expr)
    cells = [*keys, "__chunk"]

    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    totals = [F.sum(f"__in_{n}").alias(f"__tot_{n}") for n in sums]
    totals += [
        F.max_by(f"__in_{n}", F.when(F.col(f"__in_{n}").isNotNull(), rank)).alias(f"__tot_{n}")
        for n in lasts
    ]
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        staged.groupBy(*cells)
        .agg(*totals)
        .select(
            *cells,
            *[F.coalesce(F.sum(f"__tot_{n}").over(before), F.lit(0)).alias(f"__pre_{n}") for n in sums],
            *[F.last(f"__tot_{n}", ignorenulls=True).over(before).alias(f"__pre_{n}") for n in lasts],
        )
    )
    within = (
        Window.partitionBy(*cells)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    ranked = staged.select(
        "*",
        *[F.coalesce(F.sum(f"__in_{n}").over(within), F.lit(0)).alias(f"__win_{n}") for n in sums],
        *[F.last(f"__in_{n}", ignorenulls=True).over(within).alias(f"__win_{n}") for n in lasts],
    )
    kept = [c for c in df.columns if c not in sums and c not in lasts]
    return ranked.join(carry, cells).select(
        *kept,
        *[(F.col(f"__win_{n}") + F.col(f"__pre_{n}")).alias(n) for n in sums],
        *[F.coalesce(f"__win_{n}", f"__pre_{n}").alias(n) for n in lasts],
    )


def cut_by_range(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """`df` with a `chunk` column of evenly filled stretches, for `running`, when no column of the
    data cuts every key into bounded pieces. Rows are range-partitioned by (keys, order), so even
    one key at one moment spreads by the tie-breaking order columns. The result is written, since
    the sampled bounds must be the same for every later read."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(partitions, *keys, *order)
    return materialise(cut.withColumn("chunk", F.spark_partition_id()), f"ranges/{name}")


def row_numbers(
    df: DataFrame, keys: list[str], chunk: Column, order: list[str], name: str = "rn"
) -> DataFrame:
    """`row_number()` over `keys` (or over everything) without one task per key."""
    return running(df, keys, chunk, order, sums={name: F.lit(1).cast("long")})
