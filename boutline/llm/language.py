"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams,
trained by follow-the-regularised-leader with elastic-net penalties, then temperature-calibrated."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.llm.common import mixed, small, text_slices
from boutline.session import materialise

BITS = 14  # of the hashed feature space: 16,384 features a language
ORDERS = (2, 3)  # characters in an n-gram
SAMPLE_ROWS = 4000  # labelled documents used to fit weights and temperature, shared out by language
CALIBRATION = 5  # every fifth of them fits the temperature only
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 128
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Features:
    """Sparse n-gram counts of a block of texts: (text, feature, count), and letters in each text.
    Case is dropped, and every run of other characters than letters counts as one space."""

    def __init__(self):
        self.letters = _letters()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        joined = "\x00".join(["", *(t.lower().replace("\x00", " ") for t in texts)])
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        letter = self.letters[chars]
        start = chars == 0
        start_of = np.cumsum(start) - 1
        n_letters = np.bincount(start_of[letter], minlength=len(texts))
        chars = np.where(letter, chars, 32).astype(np.uint64)
        kept = letter.copy()
        kept[1:] |= letter[:-1] & ~start[1:]
        kept |= start  # a text begins with a space
        chars, text = chars[kept], start_of[kept]
        keys = []
        for k in ORDERS:
            n = len(chars) - k + 1
            if n <= 0:
                continue
            h = np.full(n, k, np.uint64)
            for i in range(k):
                h = (h << np.uint64(21)) + chars[i : i + n]  # at most 63 + 2 bits: kept apart by `mixed`
            inside = text[:n] == text[k - 1 :]
            bucket = (mixed(h[inside]) >> np.uint64(64 - BITS)).astype(np.int64)
            keys.append((text[:n][inside] << BITS) | bucket)
        counts = np.bincount(np.concatenate(keys), minlength=len(texts) << BITS) if keys else np.zeros(0, np.int64)
        found = np.flatnonzero(counts)
        return found >> BITS, found & ((1 << BITS) - 1), counts[found], n_letters


def tf_idf(text: np.ndarray, feature: np.ndarray, count: np.ndarray, idf: np.ndarray, n_texts: int) -> np.ndarray:
    value = (1 + np.log(count)) * idf[feature]
    length = np.sqrt(np.bincount(text, weights=value * value, minlength=n_texts))
    return value / np.maximum(length, 1e-12)[text]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # language x (features, one bias)
    temperature: float


def logits(weights: np.ndarray, text: np.ndarray, feature: np.ndarray, value: np.ndarray, n_texts: int) -> np.ndarray:
    out = [np.bincount(text, weights=value * w[feature], minlength=n_texts) + w[-1] for w in weights]
    return np.stack(out, axis=1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], n_langs: int) -> np.ndarray:
    """FTRL-proximal, one document after the other; weights under the L1 penalty are zero."""
    size = (1 << BITS) + 1
    z, n = np.zeros((n_langs, size)), np.zeros((n_langs, size))

    def weights(at) -> np.ndarray:
        zs, ns = z[:, at], n[:, at]
        penalty = np.where(at == size - 1, 0.0, L1)
        return np.where(np.abs(zs) <= penalty, 0.0, -(zs - np.sign(zs) * penalty) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    order = np.arange(len(rows))
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(order):
            feature, value = rows[i]
            at, x = np.append(feature, size - 1), np.append(value, 1.0)
            w = weights(at)
            p = softmax(w @ x)
            p[labels[i]] -= 1
            g = p[:, None] * x
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA
            z[:, at] += g - sigma * w
            n[:, at] += g * g
    return weights(np.arange(size))


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, cut = np.log(0.25), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many of `docs` each feature occurs, and in the last place how many there are. The
    vector has a fixed size, whatever the corpus."""
    size = (1 << BITS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(), np.zeros(size, np.int64)
        for part in text_slices(batches, most=BLOCK_BYTES, rows=BLOCK_ROWS):
            _, feature, _, _ = features(part.column("text").to_pylist())
            total += np.bincount(feature, minlength=size)
            total[-1] += part.num_rows
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["feature", "n"])

    out = np.zeros(size)
    counted = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    for row in counted.toLocalIterator():
        out[row.feature] = row.n
    return out


def _sample(docs: DataFrame, share: int) -> DataFrame:
    """Of every language the `share` rows that come first in an order drawn by id and text (all rows
    of a language with fewer). Equal rows count once. The draw is narrow: per language and group of
    hashes only the first `share` hashes are kept, so no language gathers in one task, and texts of
    the drawn rows alone are read."""
    drawn = docs.select("lang", F.xxhash64("doc_id", "text").alias("draw")).groupBy("lang", "draw").agg(F.lit(1).alias("one"))
    for by in ([F.pmod("draw", F.lit(256))], []):
        first = Window.partitionBy("lang", *by).orderBy("draw")
        drawn = drawn.withColumn("place", F.row_number().over(first)).where(F.col("place") <= share)
    chosen = small(materialise(drawn.select("lang", "draw"), "language_draws"))
    rows = docs.withColumn("draw", F.xxhash64("doc_id", "text")).join(chosen, ["lang", "draw"])
    return rows.groupBy("lang", "draw").agg(F.first("text").alias("text"))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learn from `docs` (doc_id, text, lang); rows without text or lang are left out. Feature
    statistics cover all rows; weights and temperature are fitted on at most about `sample_rows`
    rows (one of each language at least), drawn by a hash of id and text, as many from each language
    as there are, up to its share."""
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not sizes:
        return None
    langs = sorted(sizes)
    frequency = document_frequencies(docs)
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
    share = max(1, sample_rows // len(langs))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for part in text_slices(batches, most=BLOCK_BYTES, rows=BLOCK_ROWS):
            texts = part.column("text").to_pylist()
            text, feature, count, _ = features(texts)
            value = tf_idf(text, feature, count, idf, len(texts)).astype(np.float32)
            ends = np.searchsorted(text, np.arange(1, len(texts)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("lang"),
                    part.column("draw"),
                    pa.array([f.astype(np.int32).tobytes() for f in np.split(feature, ends)], pa.binary()),
                    pa.array([v.tobytes() for v in np.split(value, ends)], pa.binary()),
                ],
                names=["lang", "draw", "feature", "value"],
            )

    rows = _sample(docs, share).select("lang", "draw", "text").mapInArrow(run, "lang string, draw long, feature binary, value binary")
    got = sorted(rows.collect(), key=lambda r: (r.draw, r.lang))  # at most `share` rows of each language
    sparse = [(np.frombuffer(r.feature, np.int32), np.frombuffer(r.value, np.float32).astype(float)) for r in got]
    label = [langs.index(r.lang) for r in got]
    held = [i for i in range(len(got)) if i % CALIBRATION == CALIBRATION - 1]
    used = [i for i in range(len(got)) if i % CALIBRATION != CALIBRATION - 1]
    weights = train_ftrl([sparse[i] for i in used], [label[i] for i in used], len(langs))
    scores = np.array([weights[:, np.append(f, 1 << BITS)] @ np.append(v, 1.0) for f, v in (sparse[i] for i in held)])
    return Model(langs, idf, weights, fit_temperature(scores, np.array([label[i] for i in held], int)))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, lang_pred, score; `und` with score 0 where the
    text is NULL or has no letter, or nothing was learned. Only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for part in text_slices(batches, most=BLOCK_BYTES, rows=BLOCK_ROWS):
            texts = [t or "" for t in part.column("text").to_pylist()]
            text, feature, count, letters = features(texts)
            value = tf_idf(text, feature, count, model.idf, len(texts))
            p = softmax(logits(model.weights, text, feature, value, len(texts)) / model.temperature)
            best = p.argmax(axis=1)
            known = letters > 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([model.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]),
                    pa.array(np.where(known, p[np.arange(len(texts)), best], 0.0)),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.selectExpr("doc_id", "CAST(text AS STRING) AS text")
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, least_score: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`docs` (doc_id, text, lang and any others) without the rows whose text is `und` or predicted
    with a score under `least_score`. Learns from the rows that are not held out; without labels
    nothing can be told and every row with a letter stays."""
    model = train(docs.where(~held_out(F.col("doc_id"))), sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for part in text_slices(batches, most=BLOCK_BYTES, rows=BLOCK_ROWS):
            texts = [t or "" for t in part.column("text").to_pylist()]
            text, feature, count, letters = features(texts)
            keep = letters > 0
            if model is not None:
                value = tf_idf(text, feature, count, model.idf, len(texts))
                p = softmax(logits(model.weights, text, feature, value, len(texts)) / model.temperature)
                keep &= p.max(axis=1) >= least_score
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees. A NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of `docs` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from the rows that are not held out (see `train`), then predicts every row from its
    whole text alone. Repeated rows get equal results; other columns are ignored; an empty table
    gives an empty result; without labels every row is `und`."""
    docs = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text", "CAST(lang AS STRING) AS lang")
    model = train(docs.where(~held_out(F.col("doc_id"))), sample_rows)
    found = predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
