"""Substring deduplication by super-k-mer partitioning.

A window of 50 words is bucketed by its minimiser, the smallest hash of its shorter word m-grams.
Neighbouring windows with the same minimiser make a super-k-mer. A bucket whose minimiser occurs in
one document only cannot hold a shared window and stays at home; all windows of the others travel
as packed strings, equal strings as one, to their buckets, where sorting groups equal windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.llm.common import runs_of, small, space_words, text_key, text_slices, word_hashes
from boutline.session import materialise

WINDOW = 50  # words
GRAM = 8  # words of a minimiser's m-gram
MOST_WINDOWS = 256  # of one packed string; longer runs (a repeated word) are cut
HOT_WINDOWS = 2_000_000  # windows (about 120 bytes each while sorted) of a bucket beyond which they are dealt by content
SORTED_AT_ONCE = 200_000  # windows of small buckets sorted together
PACKED_BYTES = 1 << 20  # of packed strings whose windows are digested at once


def minimisers(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The smallest m-gram hash inside each window."""
    low = runs_of(hashes, gram)
    width = window - gram + 1
    if len(low) < width:
        return np.zeros(0, np.uint64)
    n, have = len(low) - width + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    return np.minimum(low[:n], low[width - have : width - have + n]) if width > have else low[:n]


def super_kmers(hashes: np.ndarray, starts: np.ndarray, window: int, gram: int):
    """(text, first window, windows, minimiser) of each super-k-mer of a slice. Window positions
    count words of the slice."""
    low = minimisers(hashes, window, gram)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    n = len(low)
    if not n:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    inside = text[:n] == text[window - 1 : window - 1 + n]
    change = np.ones(n, bool)
    change[1:] = (low[1:] != low[:-1]) | (text[1:n] != text[: n - 1]) | (inside[1:] != inside[:-1])
    begin = np.flatnonzero(change)
    size = np.diff(np.append(begin, n))
    kept = inside[begin]
    begin, size = begin[kept], size[kept]
    pieces = -(-size // MOST_WINDOWS)
    which = np.repeat(np.arange(len(begin)), pieces)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = begin[which] + nth * MOST_WINDOWS
    return text[at], at, np.minimum(size[which] - nth * MOST_WINDOWS, MOST_WINDOWS), low[at]


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def kmer_index(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc, doc_id, at, n, minimiser) of every super-k-mer: where it starts, and its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words, starts = space_words(part.column("text"))
            text, at, n, low = super_kmers(word_hashes(words), starts, window, gram)
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc").take(rows), part.column("doc_id").take(rows), pa.array(at - starts[text]), pa.array(n), _signed(low)],
                names=["doc", "doc_id", "at", "n", "minimiser"],
            )

    return docs.select("doc", "doc_id", "text").mapInArrow(run, "doc long, doc_id long, at long, n long, minimiser long")


def packed_strings(sharing: DataFrame, window: int) -> DataFrame:
    """(doc, doc_id, at, last, minimiser, packed) of every super-k-mer listed in `sharing` (doc,
    doc_id, text, found): its words joined by spaces; it has last + 1 windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, most=1 << 20):
            out: list[tuple] = []
            for doc, doc_id, text, found in zip(*(part.column(c).to_pylist() for c in ("doc", "doc_id", "text", "found"))):
                words = text.encode().split()  # at the ASCII white space that stands between words
                for f in found:
                    packed = b" ".join(words[f["at"] : f["at"] + f["n"] + window - 1])
                    out.append((doc, doc_id, f["at"], f["n"] - 1, f["minimiser"], packed.decode()))
            yield _batch(schema, out)

    schema = pa.schema([*((c, pa.int64()) for c in ("doc", "doc_id", "at", "last", "minimiser")), ("packed", pa.string())])
    return sharing.mapInArrow(run, "doc long, doc_id long, at long, last long, minimiser long, packed string")


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _windows(packed: bytes, window: int) -> Iterator[bytes]:
    """The windows of a packed string, one after the other."""
    ends = list(accumulate(len(w) + 1 for w in packed.split(b" ")))
    return (packed[start : end - 1] for start, end in zip([0, *ends], ends[window - 1 :]))


def _contents(packed: pa.Array, window: int) -> np.ndarray:
    """128-bit digests of all windows of packed strings (two columns), one after the other."""
    strings = packed.cast(pa.binary()).to_pylist()
    digests = b"".join(xxhash.xxh3_128_digest(w) for p in strings for w in _windows(p, window))
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)


def first_owners(strings: DataFrame, window: int, hot: int = HOT_WINDOWS) -> DataFrame:
    """(string, nth, owner): for the nth window of a packed string, the smallest id of the
    documents in which that window starts, where that is less than the string's own first.

    `strings` has one row per distinct string: string (its key), minimiser, packed, last (its
    windows less one) and first (its smallest document id). Each bucket is sorted by the digests
    of its windows, so that equal windows are neighbours. A bucket of more than `hot` windows is
    dealt out by content instead: smallest ids are found per task before the shuffle, and where one
    window's many places meet its id, adaptive execution splits them."""
    sizes = strings.groupBy("minimiser").agg(F.sum(F.col("last") + 1).alias("windows"))
    too_large = materialise(sizes.where(F.col("windows") > hot).select("minimiser"), "hot_buckets")

    def sorted_owners(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """`parts`: per slice the digests of its windows, and per string its key, first and windows."""
        if not parts:
            return _batch(schema, [])
        content, string, first, sizes = (np.concatenate(x) for x in zip(*parts))
        of = np.repeat(np.arange(len(string)), sizes)
        ids = first[of]
        order = np.lexsort((ids, content[:, 1], content[:, 0]))
        content, ids = content[order], ids[order]
        new = np.ones(len(order), bool)
        new[1:] = (content[1:] != content[:-1]).any(axis=1)
        owner = ids[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        taken = np.flatnonzero(owner < ids)
        at = order[taken]
        nth = at - (np.cumsum(sizes) - sizes)[of[at]]
        return pa.RecordBatch.from_arrays([pa.array(string[of[at]]), pa.array(nth), pa.array(owner[taken])], schema=schema)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; small buckets are sorted together, none is cut. Of what has come
        only digests, keys and ids are held."""
        last, n = None, 0
        held: list[tuple[np.ndarray, ...]] = []
        for part in text_slices(batches, "packed", PACKED_BYTES):
            content = _contents(part.column("packed"), window)
            bucket, string, first, more = (part.column(c).to_numpy() for c in ("minimiser", "string", "first", "last"))
            sizes = more + 1
            ends = np.cumsum(sizes)
            # Where buckets begin, and where those held are sorted first.
            opens = np.flatnonzero(np.concatenate([[last is None or bucket[0] != last], bucket[1:] != bucket[:-1]]))
            begin = 0
            for at in opens.tolist():
                before = int(ends[at - 1] - (ends[begin - 1] if begin else 0)) if at else 0
                if n + before > SORTED_AT_ONCE:
                    held.append((content[ends[begin - 1] if begin else 0 : ends[at - 1] if at else 0], string[begin:at], first[begin:at], sizes[begin:at]))
                    yield sorted_owners(held)
                    held, n, begin = [], 0, at
            rest = int(ends[begin - 1]) if begin else 0
            held.append((content[rest:].copy(), string[begin:].copy(), first[begin:].copy(), sizes[begin:].copy()))
            n, last = n + len(content) - rest, bucket[-1]
        yield sorted_owners(held)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "packed", PACKED_BYTES):
            content, sizes = _contents(part.column("packed"), window), part.column("last").to_numpy() + 1
            of = np.repeat(np.arange(part.num_rows), sizes)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rows = pa.array(of)
            high, low = (_signed(np.ascontiguousarray(content[:, i])) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [part.column("string").take(rows), pa.array(nth), part.column("first").take(rows), high, low],
                names=["string", "nth", "first", "high", "low"],
            )

    schema = pa.schema([("string", pa.int64()), ("nth", pa.int64()), ("owner", pa.int64())])
    usual = strings.join(small(too_large), "minimiser", "left_anti").select("minimiser", "string", "first", "packed", "last")
    usual = usual.repartition("minimiser").sortWithinPartitions("minimiser")
    settled = usual.mapInArrow(settle, "string long, nth long, owner long")
    dealt = strings.join(small(too_large), "minimiser", "left_semi").select("string", "first", "last", "packed")
    dealt = materialise(dealt.mapInArrow(deal, "string long, nth long, first long, high long, low long"), "dealt_windows")
    owners = dealt.groupBy("high", "low").agg(F.min("first").alias("owner"))
    return settled.unionByName(dealt.join(owners, ["high", "low"]).where("owner < first").select("string", "nth", "owner"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Of `docs` (doc, doc_id, text): the documents with a window that starts in another one too
    (doc, doc_id, text, found), and the spans (doc, start, length) of words covered by windows that
    start in a document with a smaller id. Rows without an id neither own a window nor lose one."""
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    index = materialise(kmer_index(known, window, gram), "super_kmers")
    spread = index.groupBy("minimiser").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("minimiser")
    found = index.join(spread, "minimiser", "left_semi").groupBy("doc").agg(F.collect_set(F.struct("at", "n", "minimiser")).alias("found"))
    lists = materialise(found, "shared_super_kmers")
    sharing = materialise(known.join(small(lists.select("doc")), "doc", "left_semi").join(lists, "doc"), "sharing_documents")
    placed = materialise(packed_strings(sharing, window).withColumn("string", text_key("packed")), "packed_strings")
    strings = materialise(placed.groupBy("string", "minimiser", "packed", "last").agg(F.min("doc_id").alias("first")), "strings")
    owners = materialise(first_owners(strings, window), "owners")
    places = placed.select("string", "doc", "doc_id", "at", "last")
    # A string that an earlier document has, too, goes whole; others lose the windows they share.
    whole = places.join(strings.select("string", "first"), "string").where("first < doc_id")
    parts = places.join(owners, "string").where("owner < doc_id")
    return sharing, whole.select("doc", F.col("at").alias("start"), (F.col("last") + window).alias("length")).unionByName(
        parts.select("doc", (F.col("at") + F.col("nth")).alias("start"), F.lit(window).cast("long").alias("length"))
    )


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _whole(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, n_words, kept_sha256) if no word is removed."""
    schema = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words = [(t or "").encode().split() for t in part.column("text").to_pylist()]
            n, kept = pa.array(list(map(len, words)), pa.int64()), pa.array(list(map(_digest, words)), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("doc_id"), n, kept], schema=schema)

    return docs.select("doc", "doc_id", "text").mapInArrow(run, "doc long, doc_id long, n_words long, kept_sha256 string")


def cut_texts(sharing: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, n_removed, kept) of the documents that lose words; `kept` is what is left, joined by
    single spaces."""
    lists = spans.groupBy("doc").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    joined = sharing.select("doc", "text").dropDuplicates(["doc"]).join(lists, "doc")
    schema = pa.schema([("doc", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, most=1 << 20):
            out = []
            for doc, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc", "text", "spans"))):
                words = text.encode().split()
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, [x["start"] for x in spans], 1)
                np.add.at(change, [x["start"] + x["length"] for x in spans], -1)
                gone = np.cumsum(change)[:-1] > 0
                out.append((doc, int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode()))
            yield _batch(schema, out)

    return joined.mapInArrow(run, "doc long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, n_removed, kept_sha256.

    NULL and empty texts have no words; texts of fewer words than a window lose none. Windows are
    judged on the input. Repeated rows and rows with equal ids do not take words from each other; a
    NULL id neither takes nor loses. Other columns are ignored; an empty table gives an empty
    result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("doc", text_key("doc_id", "text"))
    sharing, spans = repeated_spans(docs, window, gram)
    cut = cut_texts(sharing, spans).select("doc", "n_removed", F.sha2("kept", 256).alias("cut_sha256"))
    return _whole(docs).join(cut, "doc", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256")
    )
