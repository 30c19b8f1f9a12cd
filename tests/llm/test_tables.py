"""Operators in which rows meet, against plain Python on small data."""

import random
import re

from boutline.llm import decontaminate, jaccard, mixing, substrings
from boutline.llm.components import components


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ components


def closure(pairs):
    group = {}
    for a, b in pairs:
        x, y = group.get(a, {a}), group.get(b, {b})
        both = x | y
        for n in both:
            group[n] = both
    return {n: min(g) for n, g in group.items()}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(0, n) for n in range(1, 30)]
    pairs += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    got = {r.node: r.component for r in components(frame(spark, pairs, "a long, b long")).collect()}
    assert got == closure([p for p in pairs if p[0] != p[1]])
    assert components(frame(spark, [], "a long, b long")).collect() == []


# ------------------------------------------------------------------ near copies


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    pairs = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    group = closure(pairs)
    return {i: group.get(i, i) for i in sets}


def edited(rng, words, rate):
    return [rng.choice("pqrstuvw") + str(rng.randrange(99)) if rng.random() < rate else w for w in words]


def test_jaccard_groups_of_edited_copies(spark):
    """Hubs, chains and bystanders: copies edited a little, much, and copies of copies."""
    rng = random.Random(11)
    rows = []
    for group in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(30):
            text = edited(rng, base, rng.choice([0.0, 0.005, 0.01, 0.03, 0.1]))
            rows.append((len(rows), " ".join(text)))
            if rng.random() < 0.4:
                base = text  # a chain: later copies drift away from the first
            if rng.random() < 0.2:
                rows.append((len(rows), " ".join(text[: -rng.randrange(1, 4)])))
    rows += [(1000 + i, t) for i, t in enumerate(["", "one", "ONE", "one two", "two one", "One  two", "a b c", "a b c d"])]
    for k, percent in ((3, 90), (5, 80), (2, 60)):
        got = {r.doc_id: r for r in jaccard.jaccard_join(frame(spark, rows), k, percent).collect()}
        want = brute_components(rows, k, percent)
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(got[i].n_shingles == len(shingles(t, k)) for i, t in rows)


def test_keep_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(5, base), (3, base + " more"), (9, "something else entirely here"), (9, "something else entirely here"), (4, None), (None, base)]
    got = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(3, base + " more"), (9, "something else entirely here"), (4, None), (None, base)], key=str)


# ------------------------------------------------------------------ benchmark


def test_decontamination_exact_and_near(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    words = item.split()
    rows = [
        (1, "before " + item.upper() + " after"),
        (2, "x y " + " ".join(words[1:11])),
        (3, " ".join(words[:9])),
        (4, " ".join([*words[:5], "and", "then", *words[5:]])),
        (5, "short item"),
    ]
    benchmark = frame(spark, [(7, item), (8, "Short, item!"), (9, "..."), (7, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(frame(spark, rows), benchmark).collect()}
    assert got == {1: (12, 1, True), 2: (10, 1, True), 3: (0, 0, False), 4: (0, 0, False), 5: (2, 1, True)}
    _, matches = decontaminate.find_matches(frame(spark, rows), benchmark)
    assert {(r.item_id, r.kind) for r in matches.collect()} == {("7", "phrase"), ("8", "phrase"), ("7", "near")}


def test_decontamination_repeated_words(spark):
    text = "na " * 40
    benchmark = frame(spark, [(1, "na " * 14), (2, None)], "item_id long, text string")
    got = decontaminate.contamination(frame(spark, [(1, text), (2, "na na")]), benchmark).orderBy("doc_id").collect()
    assert [(r.n_hit, r.n_items) for r in got] == [(40, 1), (0, 0)]
    empty = benchmark.limit(0)
    assert [r.n_hit for r in decontaminate.contamination(frame(spark, [(1, text)]), empty).collect()] == [0]


def test_decontamination_against_every_window(spark):
    """Few different words, so that windows repeat inside items and texts, also across stretches."""
    rng = random.Random(17)
    draw = lambda n, words: [rng.choice(words) for _ in range(n)]
    items = [["na"] * 14, ["a", "b"] * 9, draw(30, "ab"), draw(4, "xyz"), draw(12, "pqrs") * 2]
    rows = [["na"] * 700, ["b", "a"] * 300, draw(900, "ab"), draw(40, "xyz"), draw(250, "pqrs") + items[4][3:20] + draw(20, "pqrs"), []]
    want = {}
    for i, w in enumerate(rows):
        hit, found = set(), set()
        for k, item in enumerate(items):
            n = min(10, len(item))
            phrases = {tuple(item[s : s + n]) for s in range(len(item) - n + 1)}
            at = [s for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in phrases]
            hit |= {p for s in at for p in range(s, s + n)}
            found |= {k} if at else set()
        want[i] = (len(w), len(hit), len(found))
    benchmark = frame(spark, [(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string")
    got = decontaminate.contamination(frame(spark, [(i, " ".join(w)) for i, w in enumerate(rows)]), benchmark).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in got} == want


# ------------------------------------------------------------------ repeated passages


def brute_removed(rows, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), i)
    out = {}
    for i, w in words.items():
        gone = {p for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < i for p in range(s, s + window)}
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def test_substrings_against_every_window(spark):
    rng = random.Random(5)
    passages = [[f"p{rng.randrange(300)}" for _ in range(rng.choice([50, 55, 90, 200]))] for _ in range(5)]
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((i * 7 % 60, " ".join(words)))
    rows += [(100, "same " * 400), (101, "same " * 300), (102, None), (103, "same " * 49)]
    import hashlib

    want = brute_removed(rows, 50)
    for hot in (2_000_000, 60):  # 60: most buckets are dealt out by content
        usual = substrings.first_owners.__defaults__
        substrings.first_owners.__defaults__ = (hot,)
        try:
            got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(frame(spark, rows)).collect()}
        finally:
            substrings.first_owners.__defaults__ = usual
        assert got == {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, (n, g, k) in want.items()}


# ------------------------------------------------------------------ mixing


def test_mixing_targets_and_copies(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix_report(docs).collect()
    assert got == mixing.mix_report(docs.repartition(7)).sort("doc_id").collect() or sorted(got) == sorted(mixing.mix_report(docs.repartition(7)).collect())
    total = sum(r.size for r in got)
    source = {i: s for i, _, s in rows}
    targets = {source[r.doc_id]: (r.target, r.source_size) for r in got}
    assert abs(sum(t for t, _ in targets.values()) - 1.5 * total) < 1e-6 * total
    level = [targets[s][0] / w for s, w in zip(["a", "b", "c", None], [5, 2, 1, 5]) if targets[s][0] < 2 * targets[s][1] - 1e-9]
    assert all(t <= 2 * n + 1e-9 for t, n in targets.values()) and max(level) - min(level) < 1e-6 * max(level)
    for s, (target, _) in targets.items():
        taken = sum(r.taken for r in got if source[r.doc_id] == s)
        assert abs(taken - target) <= 0.15 * target
    assert all(r.taken <= 2 * r.size and r.size * (r.taken // max(r.size, 1)) == r.taken for r in got)
    emitted = mixing.mix(docs).collect()
    counts = {r.doc_id: r.taken // r.size for r in got if r.size}
    seen = {i: sum(e.doc_id == i for e in emitted) for i in counts}
    assert seen == counts


def test_rows_without_an_id_or_with_one_id_or_alike_meet_the_target(spark):
    rows = [(None, f"w x{i}", "a") for i in range(1000)] + [(7, f"y z q{i}", "b") for i in range(1000)]
    rows += [(9, "same row here", "c")] * 1000 + [(i, "other " * 3, "d") for i in range(100, 500)]
    docs = frame(spark, rows, "doc_id long, text string, source string").selectExpr("*", "doc_id AS __key", "source AS copies", "doc_id AS __rate", "source AS __source")
    got = mixing.mix_report(docs).collect()
    source = {None: "a", 7: "b", 9: "c"}
    for s in "abc":
        mine = [r for r in got if source.get(r.doc_id, "d") == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.05 * mine[0].target, s
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs.repartition(5)).collect()))
    emitted = mixing.mix(docs.repartition(3)).collect()
    assert emitted[0].asDict().keys() == set(docs.columns)
    words = lambda s: sum(len(r.text.split()) for r in emitted if r.source == s)
    assert {s: words(s) for s in "abcd"} == {s: sum(r.taken for r in got if source.get(r.doc_id, "d") == s) for s in "abcd"}
    assert mixing.mix(docs.limit(0)).collect() == []
