"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20  # text handled at once by a Python worker; one longer text makes its own slice
BROADCAST_ROWS = 100_000  # fixed-width rows (at most 32 bytes each) that may be broadcast after a count

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"
NOT_LATIN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words, in lower-cased text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def inner_names(*names: str) -> Callable:
    """For a function of `docs` and more that returns rows with the columns of `docs` and uses `names`
    for columns of its own: columns of `docs` with those names are called otherwise meanwhile."""

    def around(operate: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operate)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            taken, shown = {c.lower() for c in (*docs.columns, *names)}, []
            for column in docs.columns:
                name = column
                while name.lower() in taken and column.lower() in names:
                    name += "_"
                taken.add(name.lower())
                shown.append(name)
            return operate(docs.toDF(*shown) if shown != docs.columns else docs, *args, **options).toDF(*docs.columns)

        return run

    return around


# ------------------------------------------------------------------ column expressions


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, between: str) -> Column:
    """Words of a text (NULL: none) when `between` matches what stands between them."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between), "")


def text_key(*cols: Column) -> Column:
    """A 64-bit identity of a row's content; equal rows share it."""
    return F.xxhash64(*cols)


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast if a count proves it small; otherwise Spark shuffles it.

    `df` should have fixed-width columns and be cheap to count, such as a written table."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


# ------------------------------------------------------------------ Arrow batches


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES, rows: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about `most` bytes of text and at most `rows` rows, at least one.
    After the last, the worker, which later tasks may use again, gives unused memory back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()


def space_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of a slice, and where each text's words start (one more
    entry than texts). NULL texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.not_equal(words, "")
    kept = full.to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    before = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])
    return words.filter(full), before[starts]


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return each[coded.indices.to_numpy(zero_copy_only=False)] if len(each) else np.zeros(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


FACTOR = np.uint64(0x9E3779B97F4A7C15)


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every k consecutive entries."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * FACTOR + h[i : i + n]
    return mixed(out)


def whole_runs(starts: np.ndarray, k: int) -> np.ndarray:
    """Which of the runs of k entries lie inside one text, given where texts start."""
    n = int(starts[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return text[:n] == text[k - 1 :]
