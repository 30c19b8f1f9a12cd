"""Secret scans: patterns for named secrets, and sliding-window Shannon entropy over candidate
strings for unnamed ones. Column expressions only."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.llm.common import inner_names

# Each pattern reads a text once. `access` and `hex` ask for their least length outright: a run is
# matched from its start to its end either way.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
# Least entropy, in bits a character, of the best window: by the characters a candidate uses.
CLASSES = (
    ("hex", "^[0-9A-Fa-f]+$", 3.0),
    ("alphanumeric", "^[A-Za-z0-9]+$", 3.7),
    ("base64", "^[A-Za-z0-9+/_-]+$", 3.7),  # 20 random characters of 64 repeat some: 3.9 missed 14% of them
)
# Strings that look random or long but are no secrets. A word counts where a string begins or ends.
WORDS = "(example|sample|dummy|placeholder|changeme|test|xxxx|lorem)"
ALLOWED = (
    rf"(?i)^[^a-z0-9]*{WORDS}|{WORDS}(key)?[^a-z0-9]*$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # identifiers, not secrets
    r"(?i)0123456789|abcdefghij|1234567890",
)
# A path is made of words and numbers, random characters change their kind all the time: the least
# mean length of a candidate's pieces, with which it counts as a path.
PIECE = "[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
PATH_PIECE = 2.5


SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,body:string>"


def with_spans(df: DataFrame, name: str, pattern: str, kind: str) -> DataFrame:
    """Add `name`: the leftmost non-overlapping matches in `text`, as an array of spans in code
    points. The text is split at the same pattern, so that the lengths of what stands between the
    matches place them; rows without a match skip that."""

    def placed(matches: Column) -> Column:
        between = F.slice(F.split("text", pattern, -1), F.lit(1), F.size(matches))
        pairs = F.zip_with(matches, between, lambda m, b: F.struct(m.alias("m"), F.length(b).alias("gap")))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.length(x["m"])
            span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("body"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(pairs, nothing, step)["out"]

    found = df.withColumn("__found", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    spans = F.when(F.size("__found") > 0, placed(F.col("__found"))).otherwise(F.array().cast(f"array<{SPAN}>"))
    return found.withColumn(name, spans).drop("__found")


def window_entropy(body: Column, width: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of any `width` characters in a row.

    One pass: a map of counts and the sum of c * log2(c) change by the character that enters the
    window and the one that leaves it."""
    chars = F.split(body, "")
    leaving = F.concat(F.array_repeat(F.lit(None).cast("string"), width), chars)
    moves = F.zip_with(chars, F.slice(leaving, F.lit(1), F.size(chars)), lambda i, o: F.struct(i.alias("enters"), o.alias("leaves")))
    weight = F.array(*[F.lit(float(c * log2(c)) if c else 0.0) for c in range(width + 2)])

    def changed(acc: Column, char: Column, by: int) -> Column:
        n = F.coalesce(acc["counts"][char], F.lit(0))
        rest = F.map_filter(acc["counts"], lambda k, _: k != char)
        return F.struct(
            F.map_concat(rest, F.create_map(char, n + by)).alias("counts"),
            (acc["sum"] + F.get(weight, n + by) - F.get(weight, n)).alias("sum"),
            acc["best"].alias("best"),
            (acc["seen"] + F.lit(max(by, 0))).alias("seen"),
        )

    def bound(value: Column, body: object) -> Column:
        return F.transform(F.array(value), body)[0]  # names a value that is used several times

    def step(acc: Column, move: Column) -> Column:
        kept = F.when(move["leaves"].isNull(), acc).otherwise(changed(acc, F.coalesce(move["leaves"], F.lit("")), -1))
        after = bound(kept, lambda k: changed(k, move["enters"], 1))
        entropy = lambda m: F.lit(log2(width)) - m["sum"] / width
        best = lambda m: F.when(m["seen"] >= width, F.greatest(m["best"], entropy(m))).otherwise(m["best"])
        return bound(after, lambda m: F.struct(m["counts"].alias("counts"), m["sum"].alias("sum"), best(m).alias("best"), m["seen"].alias("seen")))

    start = F.struct(
        F.create_map(F.lit(""), F.lit(0)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("seen")
    )
    return F.aggregate(moves, start, step)["best"]


def _allowed(body: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | body.rlike(pattern)
    return out


def _random(body: Column) -> Column:
    """Whether the best window has the entropy asked for by the narrowest class of characters."""
    least = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        least = F.when(body.rlike(pattern), bits).otherwise(least)
    return window_entropy(body) >= least


def _secret(body: Column) -> Column:
    """Whether a candidate, or a part of it between slashes, has letters and digits, is no allowed
    string and looks random. A slash is a base64 character: a candidate with slashes is tested
    whole too unless it looks like a path."""
    pieces = F.size(F.regexp_extract_all(body, F.lit(PIECE), F.lit(0)))
    is_path = F.length(F.regexp_replace(body, "[^A-Za-z0-9]", "")) >= PATH_PIECE * pieces
    parts = F.filter(F.split(body, "/"), lambda p: F.length(p) >= WINDOW)
    strings = F.when(body.contains("/") & ~is_path, F.concat(parts, F.array(body))).otherwise(parts)

    def secret(x: Column) -> Column:
        varied = x.rlike("[0-9]") & x.rlike("[A-Za-z]")
        return F.when(varied & ~_allowed(x), _random(x)).otherwise(False)

    return F.exists(strings, secret)


def _spans_added(docs: DataFrame) -> DataFrame:
    """`docs` (text not NULL, and any other columns) with `__spans`."""
    columns = docs.columns
    rows = with_spans(docs, "__assign", ASSIGN, "assign")
    rows = with_spans(rows, "__access", ACCESS, "access")
    rows = with_spans(rows, "__hex", HEX, "hex")
    rows = with_spans(rows, "__candidates", CANDIDATE, "entropy")
    kept = F.filter("__assign", lambda x: F.length(F.regexp_extract(x["body"], ASSIGN, 2)) >= ASSIGN_LEAST)
    rows = rows.select(*columns, "__candidates", F.concat(kept, "__access", "__hex").alias("__base"))

    def wanted(x: Column) -> Column:
        apart = ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        return F.when(apart, _secret(x["body"])).otherwise(False)

    return rows.select(*columns, F.array_sort(F.concat("__base", F.filter("__candidates", wanted))).alias("__spans"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id and its spans (start, rank, end, kind, body), by
    start and then kind.

    Candidates of the entropy rule hold letters and digits, touch no base span, and are no allowed
    string and no path of words. NULL and empty texts have no spans; repeated rows are searched each; other columns are
    ignored; an empty table gives an empty result. No row meets another: there is no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _spans_added(rows).select("doc_id", F.col("__spans").alias("spans"))


@inner_names("__text", "__assign", "__access", "__hex", "__candidates", "__base", "__spans")
def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """`docs` with `mark` in place of every span; overlapping spans get one mark. NULL texts and
    texts without secrets stay as they are, repeated rows are treated alike, an empty table gives an empty
    result; `n_chars`, if there, follows the text."""
    original = docs.withColumn("__text", F.col("text")).withColumn("text", F.coalesce("text", F.lit("")))

    def step(acc: Column, x: Column) -> Column:
        between = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(x["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], between, F.lit(mark))).alias("out"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    cleaned = F.when(F.size("__spans") > 0, F.aggregate("__spans", start, step, end)).otherwise(F.col("__text"))
    rows = _spans_added(original).withColumn("text", cleaned)
    if "n_chars" in docs.columns:
        changed = F.when(F.size("__spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
        rows = rows.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def secrets_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and the method's n_entropy."""
    text = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    base = f"filter(spans, x -> x.rank < {len(BASE_KINDS)})"
    return found.selectExpr(
        "doc_id",
        *[f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS BIGINT) AS n_{k}" for k in KINDS],
        f"sha2({text.format(base)}, 256) AS base_sha256",
        f"{text.format('spans')} AS spans",
    )
