"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio between the
trusted documents and the raw corpus, normalised by length, with a fixed threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.llm.common import mixed, runs_of, small, space_words, text_slices, whole_runs, word_hashes
from boutline.session import materialise

BUCKETS = 1 << 14  # of hashed n-grams; the two count vectors have this fixed size
ORDERS = (1, 2)  # words in an n-gram
THRESHOLD = -0.12  # nats an n-gram; a document under it is not kept
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20


def ngram_buckets(words: pa.Array, starts: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word n-gram of a slice, and the text it belongs to. Letters' case is kept:
    shouting is one of the things the ratio should see."""
    hashes = word_hashes(words)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    found, owner = [], []
    for k in ORDERS:
        inside = whole_runs(starts, k)
        found.append((mixed(runs_of(hashes, k)[inside] + np.uint64(k)) % np.uint64(buckets)).astype(np.int64))
        owner.append(text[: len(inside)][inside])
    return np.concatenate(found), np.concatenate(owner)


def ngram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-grams of all documents, and of those whose id is in `trusted`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for part in text_slices(batches):
            bucket, owner = ngram_buckets(*space_words(part.column("text")), buckets)
            raw += np.bincount(bucket, minlength=buckets)
            good = pc.fill_null(part.column("trusted"), False).to_numpy(zero_copy_only=False)
            target += np.bincount(bucket[good[owner]], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    known = materialise(trusted.select("doc_id", F.lit(True).alias("trusted")), "trusted")
    marked = docs.join(small(known), "doc_id", "left").select("text", "trusted")
    partial = marked.mapInArrow(run, "bucket long, raw long, target long")
    return partial.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target / p_raw of each bucket, both with one added to every count. Zero throughout
    if nothing is trusted. `counts` has at most `buckets` rows, which bounds what is collected."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in counts.toLocalIterator():
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def repeated_words(hashes: np.ndarray, starts: np.ndarray, k: int = REPEAT_WINDOW) -> np.ndarray:
    """Which words lie in a k-word window found twice or more in their text."""
    covered = np.zeros(len(hashes) + 1, np.int64)
    inside = whole_runs(starts, k)
    if inside.any():
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts)).astype(np.uint64)
        key = mixed(runs_of(hashes, k) + text[: len(inside)] * np.uint64(0xD6E8FEB86659FD93))[inside]
        _, index, times = np.unique(key, return_inverse=True, return_counts=True)
        at = np.flatnonzero(inside)[times[index] > 1]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + k, -1)
    return np.cumsum(covered)[:-1] > 0


def _byte_sums(texts: pa.Array, flags: np.ndarray) -> np.ndarray:
    """Sum over each text of a table of 256 values looked up by its bytes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    sums = np.concatenate([[0], np.cumsum(flags[body], dtype=np.int64)])
    at = offsets - offsets[0]
    return sums[at[1:]] - sums[at[:-1]]


def _repeated_lines(text: str) -> int:
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return again


def score_documents(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, score.

    `score` is the mean log ratio of the row's n-grams, NULL without any; a row passes if it has a
    score of `threshold` or more. NULL and empty texts have no words and fail the base rules.
    Repeated rows are judged each, alike; other columns are ignored; an empty table gives an
    empty result."""
    buckets = len(ratios)
    symbol = np.zeros(256, np.int64)
    symbol[list(SYMBOLS.encode())] = 1
    letter = np.zeros(256, np.int64)
    letter[:0x80] = 1
    letter[0xC0:] = 1  # the first byte of each code point
    letter[[0x20, *range(0x09, 0x0E)]] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = pa.array(pc.fill_null(part.column("text"), "").to_pylist(), pa.string())
            words, starts = space_words(texts)
            n_words, texts_in = np.diff(starts), len(texts)
            bucket, owner = ngram_buckets(words, starts, buckets)
            total = np.bincount(owner, weights=ratios[bucket], minlength=texts_in)
            n = np.bincount(owner, minlength=texts_in)
            score = total / np.maximum(n, 1)
            repeat = repeated_words(word_hashes(words), starts)
            sums = np.concatenate([[0], np.cumsum(repeat, dtype=np.int64)])
            n_repeat = sums[starts[1:]] - sums[starts[:-1]]
            failed = (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
            columns = [
                part.column("doc_id"),
                pa.array(n_words),
                pa.array(_byte_sums(texts, letter)),
                pa.array(_byte_sums(texts, symbol)),
                pa.array([_repeated_lines(t) for t in texts.to_pylist()], pa.int64()),
                pa.array(n_repeat),
                pa.array(failed),
                pa.array(~failed & (score >= threshold)),
                pa.array(score, mask=n == 0),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema(
        [("doc_id", pa.int64()), *((c, pa.int64()) for c in names), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())]
    )
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean, score double"
    )


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Judge every row of `docs` (doc_id, text) against the documents that `labels` (doc_id,
    quality, toxic) trusts: those labelled quality 1 and never quality 0 or toxic 1. See
    `score_documents` for the result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    trusted = (
        labels.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .where("quality = 1 AND toxic = 0")
    )
    return score_documents(docs, log_ratios(ngram_counts(docs, trusted, buckets), buckets), threshold)
