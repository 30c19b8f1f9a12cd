"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles are ordered from rare to common. Two sets that are similar enough share, for every l, at
least l of the first |x| - ceil(t |x|) + l shingles of each. Each set takes the l that its
estimated candidates make cheapest, and a pair must share as many prefix shingles as the smaller l
of the two before it is verified.

Sets that are equal are one class. A class is verified against a few hubs of its prefix shingles
first; only pairs that these links leave apart are then sought in full, so that a group of near
copies costs about as many pairs as it has members, and no link between groups is lost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.llm.common import inner_names, mixed, runs_of, small, space_words, text_key, text_slices, whole_runs, word_hashes
from boutline.llm.components import components
from boutline.session import materialise

SLICE = 1 << 20  # bytes of text handled at once: each of its words takes part in a dozen arrays
SKETCH_BITS = 18  # of the frequency sketch: one counter vector of fixed size for the whole corpus
MOST_MATCHES = 4  # longest prefix extension
PARITY = [f"parity{i}" for i in range(4)]  # 256 bits: which of 256 shares of a set are odd in size
VERIFY_COST = 20.0  # of one candidate, in posting reads
DRAWN_HUBS = 3  # of each shingle, besides the most central set
QUIET_COST = 0.25  # candidates expected of a shingle whose sketch bucket holds no more than usual


def shingle_sets(texts: pa.Array, words_in: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of a slice, sorted. A text of fewer words than a
    shingle is one shingle; one without words has none."""
    words, starts = space_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = word_hashes(words)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = whole_runs(starts, words_in)
    owners, found = [text[: len(inside)][inside]], [runs_of(hashes, words_in)[inside]]
    sizes = np.diff(starts)
    for n in range(1, words_in):
        short = np.flatnonzero(sizes == n)
        if len(short):
            rows = hashes[starts[short][:, None] + np.arange(n)]
            h = rows[:, 0]
            for i in range(1, n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + rows[:, i]
            owners.append(short)
            found.append(mixed(h + np.uint64(n)))
    owner, h = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_sketch(docs: DataFrame, words_in: int) -> np.ndarray:
    """Documents per bucket of shingles, over all documents: an upper estimate of a shingle's
    frequency. Any order of shingles gives right results; this one makes prefixes rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for part in text_slices(batches, most=SLICE):
            total += np.bincount(_bucket(shingle_sets(part.column("text"), words_in)[1]), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    counted = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for batch in counted.toArrow().to_batches():  # as many rows as the sketch has buckets, at most
        out[batch.column("bucket").to_numpy()] = batch.column("n").to_numpy()
    return out


def prefixes(docs: DataFrame, sketch: np.ndarray, words_in: int, percent: int) -> DataFrame:
    """(doc, doc_id, n, class, p, matches, parities, tokens) per row: the size of its set, the key of
    its set (NULL if empty), the base prefix, the l chosen, and the prefix for it, rare shingles
    first."""
    usual = float(sketch.sum()) / len(sketch)
    longs = ["doc", "doc_id", "n", "class", "p", "matches", *PARITY]
    schema = pa.schema([*((c, pa.int64()) for c in longs), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, most=SLICE):
            rows = part.num_rows
            owner, h = shingle_sets(part.column("text"), words_in)
            n = np.bincount(owner, minlength=rows)
            first = np.concatenate([[0], np.cumsum(n)])[:-1]
            count = sketch[_bucket(h)]
            order = np.lexsort((h, count, owner))
            ranked, cost = h[order], np.maximum(count[order] - usual, QUIET_COST)
            place = np.arange(len(h)) - first[owner]
            p = n - (-(-n * percent // 100)) + 1
            running = np.concatenate([[0.0], np.cumsum(cost)])
            best, matches = np.full(rows, np.inf), np.ones(rows, np.int64)
            for m in range(1, MOST_MATCHES + 1):
                length = p + m - 1
                ends = np.minimum(first + length, len(h))
                reads = running[ends] - running[np.minimum(first, len(h))]
                # Few candidates by chance share several rare shingles.
                total = np.where((length <= n) & (n > 0), reads * (1 + VERIFY_COST / m**2), np.inf)
                matches = np.where(total < best, m, matches)
                best = np.minimum(best, total)
            length = np.where(n > 0, p + matches - 1, 0)
            taken = place < length[owner]
            with np.errstate(over="ignore"):
                one = np.zeros(rows, np.uint64)
                two = np.zeros(rows, np.uint64)
                np.add.at(one, owner, mixed(h))
                np.bitwise_xor.at(two, owner, mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
                key = mixed(one ^ mixed(two + n.astype(np.uint64)))
            parity = np.zeros(rows * len(PARITY), np.uint64)
            share = owner * len(PARITY) + ((h >> np.uint64(6)) % np.uint64(len(PARITY))).astype(np.int64)
            np.bitwise_xor.at(parity, share, np.uint64(1) << (h & np.uint64(63)))
            bits = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in parity.reshape(rows, len(PARITY)).T]
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ranked[taken].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("doc_id"), pa.array(n), pa.array(key.view(np.int64), mask=n == 0), pa.array(p), pa.array(matches), *bits, tokens],
                schema=schema,
            )

    return docs.select("doc", "doc_id", "text").mapInArrow(run, ", ".join(f"{c} long" for c in longs) + ", tokens array<long>")


def class_sets(docs: DataFrame, classes: DataFrame, words_in: int) -> DataFrame:
    """(class, hashes) of the classes in `classes` (class, doc): their texts are read again. Rows
    that repeat a text repeat its set."""
    wanted = docs.select("doc", "text").join(small(classes), "doc").select("class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, most=SLICE):
            owner, h = shingle_sets(part.column("text"), words_in)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=part.num_rows))]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("class"), sets], names=["class", "hashes"])

    return wanted.mapInArrow(run, "class long, hashes array<long>")


def similar(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m shingles that share `shared` are similar enough, in whole numbers."""
    return 100 * shared >= percent * (n + m - shared)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """`pairs` (a, b of classes) with `linked`. Each side's set joins by class; a class in many
    pairs is a skewed key that Spark splits."""
    one = pairs.join(sets.select(F.col("class").alias("a"), F.col("hashes").alias("x")), "a")
    both = one.join(sets.select(F.col("class").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", similar(shared, F.size("x"), F.size("y"), percent).alias("linked"))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words_in: int, percent: int) -> DataFrame:
    """`verified`, with the sets of just the classes in `pairs`."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes.select("class", "doc"), "class")
    sets = materialise(class_sets(docs, materialise(needed, "needed_classes"), words_in), "class_sets")
    return verified(pairs, sets, percent)


def _pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def links(docs: DataFrame, classes: DataFrame, words_in: int, percent: int) -> DataFrame:
    """(a, b): links between classes that connect every two classes which any links connect.
    `classes` has class, doc, n, p, matches, tokens."""
    # Only shingles that stand in several prefixes can be shared; sizes are looked up for those.
    rows = classes.select("class", F.posexplode("tokens").alias("pos", "token"))
    several = rows.groupBy("token").agg(F.count(F.lit(1)).alias("lists")).where("lists > 1").select("token")
    listed = materialise(rows.join(several, "token", "left_semi"), "listed_tokens")
    # How many listed shingles a set has before each: only those can be shared earlier.
    own = listed.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("own"))
    ranked = own.join(classes.select("class", "n", "p", "matches", *PARITY), "class").select(
        "class", "n", "p", "matches", *PARITY, F.posexplode("own").alias("before", "x")
    )
    level = F.greatest(F.lit(1), F.col("x.pos") - F.col("p") + 2)
    placed = materialise(
        ranked.select("x.token", "class", "n", "p", "matches", *PARITY, F.col("x.pos").alias("pos"), "before", level.alias("level")), "placed_tokens"
    )
    # Hubs of a shingle: the set in which it stands first, and some drawn by hash, mostly the same
    # for all shingles of a group. Each set is tried with those hubs of which it shares at least
    # half of the shorter base prefix, as near copies do; what this leaves out is sought below.
    orders = [F.col("pos").cast("long"), *[F.xxhash64("class", F.lit(i)) for i in range(DRAWN_HUBS)]]
    hubs = placed.groupBy("token").agg(*[F.min(F.struct(o.alias("o"), "n", "class")).alias(f"hub{i}") for i, o in enumerate(orders)])
    offered = F.array_distinct(F.array(*[F.struct(F.col(f"hub{i}.n").alias("m"), F.col(f"hub{i}.class").alias("h")) for i in range(len(orders))]))
    to_hub = placed.join(hubs, "token").select("class", "n", "p", F.explode(offered).alias("hub")).select("class", "n", "p", "hub.*")
    sizes_fit = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)
    hub_p = F.col("m") - F.ceil(F.col("m") * percent / 100) + 1
    first = (
        to_hub.where((F.col("class") != F.col("h")) & sizes_fit(F.col("n"), F.col("m")))
        .groupBy("class", "h")
        .agg(F.count(F.lit(1)).alias("shared"), F.first("p").alias("p"), F.first("m").alias("m"))
        .where(2 * F.col("shared") >= F.least(F.col("p"), hub_p))
        .select(*_pair("class", "h"))
        .distinct()
    )
    tried = materialise(_verified(docs, classes, materialise(first, "hub_pairs"), words_in, percent), "hub_links")
    near = tried.where("linked").select("a", "b").distinct()

    group = components(near)
    placed = placed.join(group.withColumnRenamed("node", "class"), "class", "left").withColumn("group", F.coalesce("component", "class")).drop("component")
    placed = materialise(placed, "grouped_tokens")
    apart = placed.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("token")
    left = placed.join(apart, "token", "left_semi")
    right = left.select("token", *[F.col(c).alias(f"{c}_b") for c in ("class", "n", "matches", "pos", "before", "level", "group", *PARITY)])
    matches = F.least("matches", "matches_b")
    # Of the first `matches` shared shingles, this one has so many before it and after it at most.
    earlier = F.least(matches - 1, F.col("before"), F.col("before_b"))
    later = F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b")) - 1
    # Every share in which two sets differ in parity holds a shingle that only one of them has.
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in PARITY), F.lit(0))
    condition = (
        (F.col("class") < F.col("class_b"))
        & (F.col("group") != F.col("group_b"))
        & sizes_fit(F.col("n"), F.col("n_b"))
        & (F.greatest("level", "level_b") <= matches)
        & ((100 + percent) * (earlier + 1 + later) >= percent * (F.col("n") + F.col("n_b")))
        & ((100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("n_b")))
    )
    candidates = (
        left.join(right, "token")
        .where(condition)
        .groupBy(F.col("class").alias("x"), F.col("class_b").alias("y"), matches.alias("matches"))
        .agg(F.count(F.lit(1)).alias("shared"))
        .where("shared >= matches")
        .select(*_pair("x", "y"))
    )
    fresh = materialise(candidates.join(tried, ["a", "b"], "left_anti"), "candidates")
    far = materialise(_verified(docs, classes, fresh, words_in, percent).where("linked").select("a", "b").distinct(), "far_links")
    return near.unionByName(far)


def jaccard_join(docs: DataFrame, words_in: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc, doc_id, n_shingles, component_id, class, and group,
    where `doc` identifies the row's content, `class` its set and `group` the linked classes.

    Words are lower-cased (A-Z only) and cut at white space; a set holds distinct shingles of
    `words_in` words, or the whole text as one shingle if it has fewer words. Rows whose sets have
    a Jaccard similarity of `percent` / 100 or more are linked; component_id is the smallest
    doc_id that links reach. NULL, empty and blank texts have no shingles and no links; rows
    without an id have neither component nor links. Repeated rows link to each other. Other
    columns are ignored; an empty table gives an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("doc", text_key("doc_id", "text"))
    rows = materialise(prefixes(docs, frequency_sketch(docs, words_in), words_in, percent), "prefixes")
    known = rows.where("doc_id IS NOT NULL AND class IS NOT NULL")
    classes = materialise(
        known.groupBy("class").agg(
            F.min(F.struct("doc_id", "doc")).alias("m"), *[F.first(c).alias(c) for c in ("n", "p", "matches", *PARITY, "tokens")]
        ).select("class", F.col("m.doc_id").alias("first"), F.col("m.doc").alias("doc"), "n", "p", "matches", *PARITY, "tokens"),
        "classes",
    )
    group = components(links(docs, classes, words_in, percent)).withColumnRenamed("node", "class")
    grouped = classes.select("class", "first").join(group, "class", "left").withColumn("group", F.coalesce("component", "class"))
    least = grouped.groupBy("group").agg(F.min("first").alias("component_id"))
    of_class = materialise(grouped.select("class", "group").join(least, "group"), "class_components")
    # Copies join their class; only sets, never texts, are shuffled, and Spark splits a large class.
    found = rows.select("doc", "doc_id", F.col("n").alias("n_shingles"), "class").join(of_class, "class", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc", "doc_id", "n_shingles", own.alias("component_id"), "class", F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group"))


@inner_names("__doc")
def keep_one(docs: DataFrame, words_in: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without all but one row of every group: the one with the smallest id (and, of equal
    ids, the smallest content key) stays. Rows without shingles or id, such as NULL and empty texts, all
    stay; of repeated rows one stays; an empty table gives an empty result."""
    keyed = docs.withColumn("__doc", text_key(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    found = materialise(jaccard_join(docs, words_in, percent).where("`group` IS NOT NULL").select("doc", "doc_id", "group"), "groups")
    stays = materialise(found.groupBy("group").agg(F.min(F.struct("doc_id", "doc")).alias("m")).select(F.col("m.doc").alias("doc")), "stays")
    # A row's content belongs to one group: rows meet those that stay by content, so that no group meets in one task.
    gone = materialise(found.select("doc").distinct().join(stays, "doc", "left_anti").select(F.col("doc").alias("__doc")), "near_copies")
    kept = keyed.join(small(gone), "__doc", "left_anti")
    # Repeated rows have one key: they are reduced apart, so that no other text is shuffled.
    repeated = materialise(found.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("doc").alias("__doc")), "repeated_rows")
    once = kept.join(small(repeated), "__doc", "left_anti")
    again = kept.join(small(repeated), "__doc", "left_semi").dropDuplicates(["__doc"])
    return once.unionByName(again).select(*docs.columns)
