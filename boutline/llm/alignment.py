"""Alignment of two tokenizers: byte offsets where tokens of both end cut a text into groups, and
tokens of one group whose bytes overlap are linked.

Cumulative ends of either side go into an end-to-index dictionary; the sorted keys that both hold
slice the two id lists. Texts are taken in parts between which neither tokenizer ever has a token,
so each distinct part of a slice of texts is encoded and aligned once. How many documents hold a
linked id pair is counted by Spark over all documents; the counts of the most frequent pairs
(bounded in number) go to every task, those of all others are joined."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.llm.common import text_slices
from boutline.session import materialise

FREQUENT_PAIRS = 1 << 19  # pair counts sent to every task: 17 bytes each
CACHED_PARTS, CACHED_LENGTH = 400_000, 64
SLICE_BYTES, SLICE_ROWS = 1 << 20, 2_000
BAR = "▁"

IRREGULAR = re.compile(r"[ \n](?!\S)")
CUTS = re.compile(r"(?<! ) (?=\S)|(?<=\S)(?=\n\S)")


def parts_of(text: str) -> list[str]:
    """Space+text, cut before every space or line feed that stands alone before a word. `w` stands
    for a space and w; what starts with a space or a line feed stands for itself."""
    text = " " + text
    if not IRREGULAR.search(text):
        return text.replace("\n", " \n").split(" ")[1:]
    first, *rest = CUTS.split(text)
    return [first, *rest] if first else rest


def literal(part: str) -> str:
    return part if part[:1] in (" ", "\n") else " " + part


class ByteSide:
    """A byte-level vocabulary of the `tokenizers` library: ids of texts, bytes of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Printable bytes stand for themselves, the others for the code points from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.size = self.tokenizer.get_vocab_size()
        self.bytes = [b""] * self.size
        for entry, i in self.tokenizer.get_vocab().items():
            if all(c in byte_of for c in entry):
                self.bytes[i] = bytes(byte_of[c] for c in entry)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceSide:
    """A sentencepiece vocabulary, which puts a space before every text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BAR, " ").encode()
            for i, p in enumerate(map(self.model.id_to_piece, range(self.size)))
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that start with a space, or with a line feed that no piece holds."""
        spaced = [t[0] == " " for t in texts]
        found = self.model.encode([t[1:] if s else t for t, s in zip(texts, spaced)], num_threads=1)
        return [ids if s else ids[1:] for ids, s in zip(found, spaced)]


def slices(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends that both sides have, and up to which token of A and of B each reaches."""
    at_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1)))
    at_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1)))
    common = sorted(at_a.keys() & at_b.keys())
    return tuple(np.fromiter(x, np.int64, len(common)) for x in (common, map(at_a.__getitem__, common), map(at_b.__getitem__, common)))


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in A and B of every pair of tokens whose byte ranges overlap, and where the shared
    range ends: inside a slice each end of either side closes exactly one such range."""
    ends = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), ends


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


class Aligner:
    """Aligns parts, many at once laid end to end; keeps what it found of short ones."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteSide(path_a), PieceSide(path_b)
        self.size_a = np.array([len(x) for x in self.a.bytes])
        self.size_b = np.array([len(x) for x in self.b.bytes])
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.shown: list[str | None] = []  # groups as text; None: a side does not give the part back
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.pairs = np.zeros(0, np.int64)  # of all parts, one after the other

    def _given_back(self, wholes: list[bytes], ids_a: list[list[int]], ids_b: list[list[int]]) -> np.ndarray:
        """Which parts the bytes of either side's tokens make up again."""
        joined = [(b"".join([self.a.bytes[i] for i in x]), b"".join([self.b.bytes[i] for i in y])) for x, y in zip(ids_a, ids_b)]
        return np.array([x == whole == y for whole, (x, y) in zip(wholes, joined)], bool)

    def learn(self, parts: list[str]) -> None:
        """Align parts that are not known yet."""
        if not parts:
            return
        texts = [literal(p) for p in parts]
        wholes = [t.encode() for t in texts]
        ids_a, ids_b = self.a.encode(texts), self.b.encode(texts)
        good = self._given_back(wholes, ids_a, ids_b)
        flat_a, sizes_a = _flat([x if g else [] for x, g in zip(ids_a, good)])
        flat_b, sizes_b = _flat([x if g else [] for x, g in zip(ids_b, good)])
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        borders = np.cumsum(np.where(good, np.fromiter(map(len, wholes), np.int64, len(wholes)), 0))  # where parts end
        ends, to_a, to_b = slices(ends_a, ends_b)
        from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
        text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        groups = [
            f"{text_a[i]}|{text_b[j]}" if to_i == i + 1 and to_j == j + 1 else f"{','.join(text_a[i:to_i])}|{','.join(text_b[j:to_j])}"
            for i, to_i, j, to_j in zip(from_a.tolist(), to_a.tolist(), from_b.tolist(), to_b.tolist())
        ]
        last = np.searchsorted(ends, borders, side="right")
        n_groups = np.diff(last, prepend=0)
        at_a, at_b, link_ends = links(ends_a, ends_b)
        n_links = np.diff(np.searchsorted(link_ends, borders, side="right"), prepend=0)
        self.known.update(zip(parts, range(len(self.shown), len(self.shown) + len(parts))))
        stops = last.tolist()
        self.shown += [";".join(groups[i:j]) if g else None for i, j, g in zip([0, *stops], stops, good.tolist())]
        self.numbers = np.concatenate([self.numbers, np.stack([sizes_a, sizes_b, n_groups, n_links], axis=1)])
        self.pairs = np.concatenate([self.pairs, flat_a[at_a] * self.b.size + flat_b[at_b]])

    def __call__(self, texts: list[str]) -> dict[str, list]:
        """Columns of a slice of texts: numbers, digest of the groups, distinct pairs and how often each is linked."""
        rows = [parts_of(t) if t else [] for t in texts]
        if len(self.known) > CACHED_PARTS:
            self.clear()
        distinct = set().union(*rows)
        self.learn([p for p in distinct if len(p) <= CACHED_LENGTH and p not in self.known])
        short = len(self.shown)
        long = [p for p in distinct if len(p) > CACHED_LENGTH]
        self.learn(long)
        starts = np.concatenate([[0], np.cumsum(self.numbers[:, 3])])
        out: dict[str, list] = {n: [] for n in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "times")}
        for row in rows:
            at = list(map(self.known.__getitem__, row))
            shown = list(map(self.shown.__getitem__, at))
            if not row or None in shown:
                values = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
            else:
                at = np.array(at)
                numbers = self.numbers[at]
                n = numbers[:, 3]
                before = np.cumsum(n) - n
                pairs = self.pairs[np.repeat(starts[at] - before, n) + np.arange(int(n.sum()))]
                pair, times = np.unique(pairs, return_counts=True)
                values = (*numbers.sum(axis=0).tolist(), hashlib.sha256(";".join(shown).encode()).hexdigest(), pair, times)
            for column, value in zip(out.values(), values):
                column.append(value)
        for p in long:  # these go again
            del self.known[p]
        del self.shown[short:]
        self.pairs, self.numbers = self.pairs[: starts[short]], self.numbers[:short]
        return out


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *values]), kind))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, `text_key` (128 bits), n_a, n_b, n_groups, n_links,
    groups_sha256, and the distinct linked id pairs `pair` (a * size of B + b) with how often each
    is linked, `times`. Texts that a tokenizer does not give back byte by byte have no tokens."""
    most = ByteSide(path_a).size * PieceSide(path_b).size
    number, kind = ("int", pa.int32()) if most < 1 << 31 else ("long", pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for part in text_slices(batches, most=SLICE_BYTES, rows=SLICE_ROWS):
            aligner = aligner or Aligner(path_a, path_b)
            texts = part.column("text").to_pylist()
            found = aligner([t or "" for t in texts])
            keys = [hashlib.md5(t.encode()).digest() if t is not None else None for t in texts]
            columns = [part.column("doc_id"), pa.array(keys, pa.binary())]
            columns += [pa.array(found[n], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
            columns += [pa.array(found["groups_sha256"]), _lists(found["pair"], kind), _lists(found["times"], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "times"])

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    numbers = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    return rows.mapInArrow(run, f"doc_id long, text_key binary, {numbers}, pair array<{number}>, times array<int>")


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many rows of `aligned` each pair is linked, and whether no other
    pair of its A id is in more. The best counts are one row per id of A's vocabulary."""
    counts = found.select(F.explode("pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "alignment_counts").withColumn("id_a", F.floor(F.col("pair") / size_b).cast("int"))
    top = counts.groupBy("id_a").agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(top), "id_a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _threshold(counts: DataFrame, most: int) -> int:
    """The least power of two that at most `most` pairs reach; at most 64 rows are collected."""
    bins = {r.bin: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).alias("bin")).count().collect()}
    bin_, reached = max(bins, default=-1) + 1, 0
    while bin_ > 0 and reached + bins.get(bin_ - 1, 0) <= most:
        bin_ -= 1
        reached += bins.get(bin_, 0)
    return 1 << bin_


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256.

    A tokenizes space+text, B the text, to which it adds the space. A pair's count is the number of
    rows that hold it linked (repeated rows count each); n_best counts the links whose count is the
    highest of their A id, count_sum adds up the counts over links. NULL and empty texts, and texts
    that A or B changes, have no tokens: zeros and an empty digest. Other columns are ignored; an
    empty table gives an empty result."""
    found = materialise(aligned(docs, path_a, path_b), "alignment")
    counts = materialise(pair_counts(found, PieceSide(path_b).size), "alignment_pairs")
    least = _threshold(counts, frequent)
    common = counts.where(F.col("n") >= least).toArrow()  # at most `frequent` rows of 17 bytes
    order = np.argsort(common["pair"].to_numpy())
    known = [common[c].to_numpy()[order] for c in ("pair", "n", "best")]
    shared = docs.sparkSession.sparkContext.broadcast(known)
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    kept = ["doc_id", "text_key", *numbers, "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, times = batch.column("pair"), batch.column("times").flatten().to_numpy().astype(np.int64)
            pair = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            total, good = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(total, row[hit], n[at[hit]] * times[hit])
            np.add.at(good, row[hit], best[at[hit]] * times[hit])
            rest = np.bincount(row[~hit], minlength=batch.num_rows)
            split = np.split(np.flatnonzero(~hit), np.cumsum(rest)[:-1])
            columns = [batch.column(c) for c in kept] + [pa.array(good), pa.array(total)]
            columns += [_lists([pair[s] for s in split], pa.int64()), _lists([times[s] for s in split], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_best", "count_sum", "rest", "rest_times"])

    schema = ", ".join(
        ["doc_id long", "text_key binary", *[f"{c} long" for c in numbers], "groups_sha256 string", "n_best long", "count_sum long"]
    )
    summed = found.mapInArrow(run, f"{schema}, rest array<long>, rest_times array<long>")
    out = ["doc_id", *numbers, "n_best", "count_sum", "groups_sha256"]
    if least == 1:  # every pair was known to every task
        return summed.select(out)
    summed = materialise(summed, "alignment_sums")
    cells = summed.select("text_key", F.explode(F.arrays_zip("rest", "rest_times")).alias("cell"))
    cells = cells.select("text_key", F.col("cell.rest").alias("pair"), F.col("cell.rest_times").alias("times"))
    # Rows of equal texts hold equal cells: one of each is counted for the text.
    rare = cells.groupBy("text_key", "pair").agg(F.max("times").alias("times")).join(counts.where(F.col("n") < least), "pair")
    more = rare.groupBy("text_key").agg(
        F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best")
    )
    return summed.join(more, "text_key", "left").select(
        "doc_id",
        *numbers,
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
