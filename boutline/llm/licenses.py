"""License scans by diagonal voting: every k consecutive words of a text are looked up among the
k-grams of license templates; hits vote for a template and an offset (diagonal), neighbouring
diagonals are merged, and the spans they claim are verified. Column expressions and joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutline.llm.common import NOT_LATIN, lower_ascii, split_words

K = 3  # words in a k-gram: the shortest base phrase has three
DRIFT = 4  # diagonals this close (words put in or left out) belong to one span
MIN_COVER = 0.6  # of a notice's k-grams, for a label of the method's own
SHORT = 10  # a notice of fewer k-grams must be covered whole: its last words tell versions apart

# Phrases of the base rule, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Opening sentences of public license notices: fixed values, as their publishers word them.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license", "lgpl"),
    ("licensed under the gnu affero general public license version 3", "agpl-3"),
    ("licensed under the gnu lesser general public license version 3", "lgpl-3"),
    ("licensed under the gnu lesser general public license version 2 1", "lgpl-2.1"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noderivatives 4 0 international license", "cc-by-nd"),
    ("this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "cc-by-nc-sa"),
    ("this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", "cc-by-nc-nd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

# Words that tell the licenses of a family apart, by what they stand for: a span of a notice must
# hold those of its template and no other.
FAMILIES = (
    ("creative commons", {"noncommercial": "nc", "commercial": "nc", "sharealike": "sa", "alike": "sa", "noderivatives": "nd", "noderivs": "nd", "derivatives": "nd", "derivs": "nd"}),
    ("gnu", {"lesser": "lesser", "affero": "affero"}),
)
MARKS = {word: mark for _, words in FAMILIES for word, mark in words.items()}


def template_marks() -> list[tuple[list[str], list[str]]]:
    """(marks of its family, marks of its own) per template; none for base phrases."""
    out = []
    for i, (text, _) in enumerate((*PHRASES, *NOTICES)):
        family = next((words for name, words in FAMILIES if i >= len(PHRASES) and name in text), {})
        out.append((sorted(set(family.values())), sorted({family[w] for w in text.split() if w in family})))
    return out


def template_grams(spark: SparkSession, k: int = K) -> DataFrame:
    """(gram, words, template, label, is_base, at, n_grams): one row per k-gram of a template. A
    fixed table of a few hundred rows."""
    rows = [(i, text.split(), label, i < len(PHRASES)) for i, (text, label) in enumerate((*PHRASES, *NOTICES))]
    grams = [(t, label, base, at, words[at : at + k], len(words) - k + 1) for t, words, label, base in rows for at in range(len(words) - k + 1)]
    made = spark.createDataFrame(grams, "template int, label string, is_base boolean, at int, words array<string>, n_grams int")
    return made.withColumn("gram", F.xxhash64(*[F.col("words")[i] for i in range(k)]))


def license_hits(docs: DataFrame, k: int = K) -> DataFrame:
    """Votes, and one row without a template per row of `docs` (its first word): row, doc_id,
    n_words, pos, marks (pos, mark; at the first word only), and the template's template, label,
    is_base, at, n_grams."""
    words = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), split_words(lower_ascii(F.coalesce("text", F.lit(""))), NOT_LATIN).alias("words")
    )
    named = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])
    placed = F.transform("words", lambda w, i: F.struct(i.alias("pos"), F.when(w.isin(*MARKS), named[w]).alias("mark")))
    words = words.withColumn("marks", F.filter(placed, lambda m: m["mark"].isNotNull()))
    each = words.select("row", "doc_id", F.size("words").alias("n_words"), "words", "marks", F.posexplode_outer("words").alias("pos", "word"))
    each = each.withColumn("marks", F.when(F.col("pos") == 0, F.col("marks")))
    gram = each.withColumn("gram", F.xxhash64("word", *[F.get("words", F.col("pos") + i) for i in range(1, k)]))
    templates = F.broadcast(template_grams(docs.sparkSession, k)).withColumnRenamed("words", "template_words")
    # The hash finds, the words decide.
    same = (F.col("gram") == F.col("g")) & (F.slice("words", F.col("pos") + 1, k) == F.col("template_words"))
    joined = gram.join(templates.withColumnRenamed("gram", "g"), same, "left")
    return joined.where("template IS NOT NULL OR pos = 0 OR pos IS NULL").select(
        "row", "doc_id", "n_words", "pos", "marks", "template", "label", "is_base", "at", "n_grams"
    )


def scan_licenses(docs: DataFrame, k: int = K, drift: int = DRIFT, min_cover: float = MIN_COVER) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, and spans (template, label, first, last, cover) found.

    A base phrase counts where all its k-grams vote on one diagonal, which is where its words
    stand; a notice counts where the merged diagonals cover at least `min_cover` of its k-grams, a
    short one where they cover all.
    `score` is the best cover (1 for a base phrase), 0 without a label. NULL and empty texts have
    no words and no labels; repeated rows are scanned each; other columns are ignored; an empty
    table gives an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = license_hits(docs, k)
    # Votes of one diagonal; the row that stands for the text itself goes along as template -1.
    votes = hits.groupBy("row", F.coalesce("template", F.lit(-1)).alias("template"), (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.first("marks", ignorenulls=True).alias("marks"),
        F.first("label").alias("label"),
        F.first("is_base").alias("is_base"),
        F.first("n_grams").alias("n_grams"),
        F.min("at").alias("low"),
        F.max("at").alias("high"),
        F.collect_set("at").alias("ats"),
    )
    # Neighbouring diagonals of a notice that continue each other make one span.
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    joined = votes.withColumn("opens", F.when(F.col("is_base") | gap.isNull() | (gap > drift), 1).otherwise(0))
    numbered = joined.withColumn("span", F.sum("opens").over(order))
    spans = numbered.groupBy("row", "template", "span").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.first("marks", ignorenulls=True).alias("marks"),
        F.first("label").alias("label"),
        F.first("is_base").alias("is_base"),
        F.first("n_grams").alias("n_grams"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("ats")))) / F.first("n_grams")).alias("cover"),
        F.min(F.col("diagonal") + F.col("low")).alias("first"),
        F.max(F.col("diagonal") + F.col("high") + k - 1).alias("last"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    enough = (F.col("template") >= 0) & F.when(F.col("n_grams") < SHORT, F.col("cover") == 1.0).otherwise(F.col("cover") >= min_cover)
    base = enough & F.col("is_base")
    # By cover, then length: the order in which spans are kept.
    span = F.struct(
        (-F.col("cover")).alias("rank"), (-F.col("n_grams")).alias("size"), "first", "last", "template", "label", "cover",
        (F.col("first") - F.col("low")).alias("begins"), (F.col("last") + F.col("n_grams") - 1 - F.col("high")).alias("ends"),
    )
    found = spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").cast("long").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(base, F.col("label"))))).alias("base_labels"),
        F.first("marks", ignorenulls=True).alias("marks"),
        F.array_sort(F.collect_list(F.when(base, span))).alias("phrases"),
        F.array_sort(F.collect_list(F.when(enough & ~F.col("is_base"), span))).alias("notices"),
    )
    strings = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    family, own = (F.array(*[strings(x) for x in column]) for column in zip(*template_marks()))

    def verified(x: Column) -> Column:
        """The words that tell a family apart, where the whole template would stand, are its own."""
        inside = lambda m: (m["pos"] >= x["begins"]) & (m["pos"] <= x["ends"]) & F.array_contains(F.get(family, x["template"]), m["mark"])
        there = F.transform(F.filter(F.coalesce("marks", F.array().cast("array<struct<pos:int,mark:string>>")), inside), lambda m: m["mark"])
        return F.array_sort(F.array_distinct(there)) == F.get(own, x["template"])

    def apart(kept: Column, x: Column) -> Column:
        """Spans that share a k-gram's words compete; the better one is there already."""
        shared = lambda o: F.least(o["last"], x["last"]) - F.greatest(o["first"], x["first"]) + 1
        return F.when(F.exists(kept, lambda o: shared(o) >= k), kept).otherwise(F.concat(kept, F.array(x)))

    best = F.aggregate(F.filter("notices", verified), F.slice("notices", 1, 0), apart)
    kept = found.withColumn("kept", F.concat("phrases", best))
    shown = F.transform("kept", lambda x: F.struct(*[x[c].alias(c) for c in ("first", "last", "template", "label", "cover")]))
    return kept.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("kept", lambda x: x["label"])))).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda x: x["cover"])), F.lit(0.0)).alias("score"),
        F.array_sort(shown).alias("spans"),
    )
