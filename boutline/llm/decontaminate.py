"""Benchmark decontamination over a positional inverted index: postings of the rarest benchmark
words, offset-adjusted intersections, exact phrases and proximity matches. Column expressions and
joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.llm.common import NOT_LATIN, inner_names, lower_ascii, small, split_words, text_key
from boutline.session import materialise

WINDOW = 10  # consecutive words of an item
SLACK = 3  # words by which a proximity match may be off
BUCKET = 16  # positions are joined by stretches of so many words
STRETCH = 256  # words of a document that verification reads at once, besides those of one window


def _words(text: Column) -> Column:
    return split_words(lower_ascii(F.coalesce(text, F.lit(""))), NOT_LATIN)


def benchmark_terms(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n, at, term, word): every word of every different item. `item` identifies
    the item's content, `term` hashes the word."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).dropDuplicates()
    keyed = items.select(text_key("item_id", "text").alias("item"), "item_id", _words(F.col("text")).alias("words"))
    each = keyed.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    return each.withColumn("term", F.xxhash64("word"))


def document_terms(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, n_words, pos, term): every word of every row, and one row without a word for
    a text that has none. `doc` identifies the row's content."""
    words = docs.select(text_key("doc_id", "text").alias("doc"), "doc_id", _words(F.col("text")).alias("words"))
    each = words.select("doc", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    return each.select("doc", "doc_id", "n_words", "pos", F.xxhash64("word").alias("term"))


def item_windows(terms: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, item_id, s, a_at, a_term, b_at, b_term, phrase): the different windows of each item, where
    each stands first, its words, and its two rarest words by occurrences in the corpus (ties: by word,
    then place)."""
    counted = terms.join(counts, "term", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    line = counted.groupBy("item").agg(
        F.first("item_id").alias("item_id"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "c", "word", "term"))).alias("line")
    )
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))
    parts = F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice("line", s + 1, window).alias("part")))
    cut = line.select("item", "item_id", F.explode(parts).alias("w")).select("item", "item_id", "w.s", "w.part")
    rare = F.array_sort(F.transform("part", lambda x: F.struct(x["c"], x["word"], x["at"], x["term"])))
    place = lambda x, name: F.struct(x["at"].alias("at"), x["term"].alias("term")).alias(name)
    ranked = cut.select("item", "item_id", "s", F.transform("part", lambda x: x["word"]).alias("phrase"), rare.alias("rare"))
    picked = ranked.select("item", "item_id", "phrase", "s", place(F.col("rare")[0], "a"), place(F.coalesce(F.get("rare", F.lit(1)), F.col("rare")[0]), "b"))
    # A window that an item repeats is sought once: every place where it stands is found by its first.
    first = picked.groupBy("item", "item_id", "phrase").agg(F.min(F.struct("s", "a", "b")).alias("m"))
    return first.select(
        "item", "item_id", "m.s", F.col("m.a.at").alias("a_at"), F.col("m.a.term").alias("a_term"), F.col("m.b.at").alias("b_at"), F.col("m.b.term").alias("b_term"), "phrase"
    )


def positional_index(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Postings (doc, term, pos) of the anchor words, and one row with `pos` 0 or NULL and no term
    per row of `docs`, which carries doc_id and n_words. Written once, read by every later step."""
    wanted = materialise(anchors.select(F.explode(F.array("a_term", "b_term")).alias("wanted")).distinct(), "anchor_terms")
    each = document_terms(docs).join(small(wanted), F.col("term") == F.col("wanted"), "left")
    kept = each.where("wanted IS NOT NULL OR pos = 0 OR pos IS NULL")
    return materialise(kept.select("doc", "doc_id", "n_words", "pos", F.col("wanted").alias("term")), "positional_index")


def aligned(index: DataFrame, anchors: DataFrame, slack: int = SLACK) -> DataFrame:
    """(doc, item, a_at, b_at, shift, off): places where the rarest word of a window stands in a
    document, and the second rarest `off` words away from where it should (0: in its place).

    The rarest word's postings, moved by its offset in the item, are intersected with those of the
    second rarest by document, word and stretch of positions."""
    postings = index.where("term IS NOT NULL").select("doc", "term", "pos").distinct()
    first = postings.join(small(anchors), F.col("term") == F.col("a_term")).select(
        "doc", "item", "a_at", "b_at", (F.col("pos") - F.col("a_at")).alias("shift"), (F.col("pos") - F.col("a_at") + F.col("b_at")).alias("due"), "b_term"
    )
    stretches = F.array_distinct(F.array(*[F.floor((F.col("due") + d) / BUCKET) for d in (-slack, slack)]))
    asked = first.withColumn("stretch", F.explode(stretches))
    there = postings.select(F.col("doc").alias("d"), F.col("term").alias("t"), "pos", F.floor(F.col("pos") / BUCKET).alias("p"))
    met = asked.join(there, (F.col("doc") == F.col("d")) & (F.col("b_term") == F.col("t")) & (F.col("stretch") == F.col("p")))
    off = F.abs(F.col("pos") - F.col("due"))
    return met.where(off <= slack).select("doc", "item", "a_at", "b_at", "shift", off.alias("off"))


def phrases(docs: DataFrame, windows: DataFrame, candidates: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, item_id, start, length): windows of items that stand in a document word by word.

    `candidates` has doc, item, a_at, b_at and shift. Only documents with a candidate are read again,
    in stretches; a candidate meets the one stretch in which it starts, so that the work follows the
    length of a document and the number of its candidates, not their product."""
    tried = candidates.join(windows, ["item", "a_at", "b_at"]).select("doc", "item_id", (F.col("shift") + F.col("s")).alias("start"), "phrase")
    tried = tried.where("start >= 0").withColumn("stretch", F.floor(F.col("start") / STRETCH).cast("int"))
    listed = materialise(candidates.select("doc").distinct(), "candidate_documents")
    keyed = docs.select(text_key("doc_id", "text").alias("doc"), "text")
    chosen = keyed.join(small(listed), "doc", "left_semi").dropDuplicates(["doc"]).select("doc", _words(F.col("text")).alias("words"))
    last = F.floor(F.greatest(F.size("words") - 1, F.lit(0)) / STRETCH).cast("int")
    parts = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("stretch"), F.slice("words", i * STRETCH + 1, STRETCH + window).alias("part"))
    )
    stretches = chosen.select("doc", F.explode(parts).alias("x")).select("doc", "x.stretch", "x.part")
    length = F.size("phrase")
    equal = F.slice("part", F.col("start") - F.col("stretch") * STRETCH + 1, length) == F.col("phrase")
    return tried.join(stretches, ["doc", "stretch"]).where(equal).select("doc", "item_id", "start", length.alias("length"))


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = SLACK) -> tuple[DataFrame, DataFrame]:
    """The index (see `positional_index`) and the matches (doc, item_id, kind, start, length) of
    `benchmark` (item_id, text) in `docs` (doc_id, text).

    Kind `phrase`: all words of a window stand there. Kind `near`: its two rarest words stand
    within `slack` words of their distance, with `start` where the item would begin; whole phrases
    of the same item and place are not repeated. An item of fewer words than a window is one
    window; one without words never matches; of equal items one is used."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = materialise(benchmark_terms(benchmark), "benchmark_terms")
    vocabulary = materialise(terms.select(F.col("term").alias("t")).distinct(), "benchmark_vocabulary")
    spoken = document_terms(docs).where("pos IS NOT NULL").join(small(vocabulary), F.col("term") == F.col("t"))
    counts = spoken.groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    windows = materialise(item_windows(terms, counts, window), "item_windows")
    anchors = materialise(windows.select("item", "a_at", "a_term", "b_at", "b_term").distinct(), "anchors")
    index = positional_index(docs, anchors)
    places = materialise(aligned(index, anchors, slack).groupBy("doc", "item", "a_at", "b_at", "shift").agg(F.min("off").alias("off")), "aligned")
    exact = materialise(phrases(docs, windows, places.where("off = 0"), window).distinct(), "phrases")
    ids = terms.select("item", "item_id").distinct()
    near = places.select("doc", "item", "shift").distinct().join(ids, "item").join(
        exact.select("doc", "item_id").distinct(), ["doc", "item_id"], "left_anti"
    ).select("doc", "item_id", F.lit("near").alias("kind"), F.col("shift").alias("start"), F.lit(None).cast("int").alias("length"))
    return index, exact.select("doc", "item_id", F.lit("phrase").alias("kind"), "start", "length").unionByName(near)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, and n_near, the items with proximity matches only.

    NULL and empty texts have no words. Repeated rows are reported each, alike; rows that share an
    id but not the text are reported apart. An item without id adds hits but no item. Other
    columns are ignored; empty tables give results without rows or without hits."""
    index, matches = find_matches(docs, benchmark, window, slack)
    places = F.collect_set(F.when(F.col("kind") == "phrase", F.struct("start", "length")))
    hit = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p["start"], p["start"] + p["length"] - 1))))
    of_kind = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("item_id")))
    found = matches.groupBy("doc").agg(
        F.size(hit).cast("long").alias("n_hit"), F.array_sort(of_kind("phrase")).alias("items"), F.size(of_kind("near")).cast("long").alias("n_near")
    )
    heads = index.where("pos = 0 OR pos IS NULL").select("doc", "doc_id", "n_words")
    none = F.array().cast("array<string>")
    return heads.join(found, "doc", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


@inner_names("__doc")
def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the rows in which a window of an item stands word by word. NULL and empty texts
    stay; repeated rows go or stay alike; empty tables give an empty result or all of `docs`."""
    _, matches = find_matches(docs, benchmark, window)
    found = materialise(matches.where("kind = 'phrase'").select(F.col("doc").alias("__doc")).distinct(), "contaminated")
    keyed = docs.withColumn("__doc", text_key(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return keyed.join(small(found), "__doc", "left_anti").select(*docs.columns)
