"""Mixing sources to target weights: repetition rates per source, whole copies plus one
hash-seeded Bernoulli copy per document. Column expressions and joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.llm.common import SPACE, small, split_words
from boutline.session import materialise

WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
SHARE_PERCENT = 150  # of all sizes, shared out among the sources
MOST_REPEATS = 2  # a source's target stops at so many times its size


def word_count(text: Column) -> Column:
    return F.size(split_words(text, SPACE)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target, rate) from (source, size).

    Resharing the excess of full sources by weight, until none is above its stop, ends with
    target = min(stop, level * weight) for one level. Sources fill in the order of stop / weight,
    so the level follows from running sums in that order: no iteration is needed. One row per
    source goes through the ordering window, never a document."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    named = totals.select("*", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("stop"))
    filling = Window.orderBy((F.col("stop") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ordered = named.select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        F.coalesce(F.sum("stop").over(before), F.lit(0)).alias("full"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("full_weight"),
    )
    # The level if exactly the sources before this one are full.
    level = (F.col("all_size") * share_percent - 100 * F.col("full")) / F.lit(100.0) / (F.col("all_weight") - F.col("full_weight"))
    tried = ordered.withColumn("level", level)
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct("full_weight", "level"))).over(everything)
    target = F.when(
        fits.isNull() | (F.col("full_weight") < fits["full_weight"]), F.col("stop").cast("double")
    ).otherwise(fits["level"] * F.col("weight"))
    placed = tried.select("source", "source_size", target.alias("target"))
    return placed.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def row_key(docs: DataFrame) -> Column:
    """128 bits of a row's whole content; equal rows share it."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in sorted(docs.columns)]
    return F.unhex(F.md5(F.concat_ws("|", *shown)))


def copies(key: Column, number: Column, rate: Column, seed: str) -> Column:
    """floor(rate) copies, one more with probability rate - floor(rate) by a hash of the row and of
    its number among equal rows. Rows without an id, or with one id, draw apart."""
    drawn = F.concat(F.lit(f"{seed}:"), F.lower(F.hex(key)), F.lit(":"), number.cast("string"))
    chance = F.conv(F.substring(F.md5(drawn), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def _same_source(source: Column) -> Column:
    return source.eqNullSafe(F.col("__source"))  # a NULL source is a source too


def _rated(docs: DataFrame) -> DataFrame:
    """(__key, doc_id, __source, size, n, source_size, target, rate) per distinct row of `docs`, n times there."""
    rows = docs.select(
        row_key(docs).alias("__key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
    )
    distinct = rows.groupBy("__key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    distinct = materialise(distinct, "mix_rows")  # texts are read once; no text is shuffled
    sizes = distinct.select("source", (F.col("size") * F.col("n")).alias("size"))
    targets = source_targets(sizes).withColumnRenamed("source", "__source")
    return distinct.join(targets, _same_source(F.col("source")), "left").drop("source")


def mix_report(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Per row of `docs` (doc_id, text, source): doc_id, size, source_size, target, taken.

    Size is the number of words (NULL text: 0). Every row draws its own number, from its content and
    its place among equal rows, so reruns agree however rows are dealt. A source without words has
    target 0 and is not taken. An empty table gives an empty result; other columns only tell rows
    apart."""
    numbered = _rated(docs).withColumn("number", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    taken = copies(F.col("__key"), F.col("number"), F.col("rate"), seed) * F.col("size")
    return numbered.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mixture: every row of `docs` as often as it is taken, with its columns unchanged.

    NULL texts have size 0 and stay as often as their source's rate says; a row of a source without
    words goes. Equal rows are drawn apart: of those one is kept and emitted as often as all together
    are drawn, so only rows that repeat are shuffled. An empty table gives an empty result."""
    inner = [f"__mix_{i}" for i in range(len(docs.columns))]  # no name of the table can clash
    rated = materialise(_rated(docs), "mix_rated")
    # One row a source, written: a plan that knows its size does not shuffle the texts by source.
    rates = materialise(rated.groupBy("__source").agg(F.max("rate").alias("rate")), "mix_rates")
    again = rated.where("n > 1").select("__key", "rate", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("number"))
    again = again.groupBy("__key").agg(F.sum(copies(F.col("__key"), F.col("number"), F.col("rate"), seed)).alias("copies"))
    again = small(materialise(again, "mix_repeated"))
    rows = docs.select(
        row_key(docs).alias("__key"), F.col("source").cast("string").alias("source"), *[F.col(f"`{c}`").alias(i) for c, i in zip(docs.columns, inner)]
    )
    joined = rows.join(rates, _same_source(F.col("source")), "left").join(again, "__key", "left")
    once = joined.where("copies IS NULL").withColumn("copies", copies(F.col("__key"), F.lit(1), F.col("rate"), seed))
    kept = joined.where("copies IS NOT NULL").groupBy("__key", "copies").agg(*[F.first(i).alias(i) for i in inner])
    out = once.select("copies", *inner).unionByName(kept.select("copies", *inner)).where("copies > 0")
    emitted = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return emitted.select(*[F.col(i).alias(c) for c, i in zip(docs.columns, inner)])
