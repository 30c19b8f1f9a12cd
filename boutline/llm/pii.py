"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from boutline.llm.common import text_slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")

# Patterns whose repeats never give back what they took: each reads a text once. The look-behinds
# leave out starts inside a run whose start has failed already.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")

NEAR = 40  # code points looked at on either side of a span
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "pay", "mastercard"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "bank", "account", "konto", "transfer", "bic"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8}
AGAINST = ("example", "version", "isbn", "order", "invoice", "sample")
KEPT_SCORE = 0.5  # a span of the method's own kinds needs so much


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: found from each @, so that long runs are read once."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > free and not LOCAL_END.match(text, start - 1):
                start -= 1
            if start < at:
                yield start, domain.end()
                free = domain.end()
        at = text.find("@", max(at + 1, free))


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def proposals(text: str) -> Iterator[tuple[int, int, str]]:
    """Confirmed spans (start, end, kind) of every kind, in code points."""
    for start, end in _emails(text):
        yield start, end, "email"
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            yield m.start(), m.end(), "ip"
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end(), "card"
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            yield m.start(), m.end(), "phone"
    for m in IBAN.finditer(text):
        account = m[0]
        while len(account.replace(" ", "")) >= 15:  # words in capitals may follow: try without them
            if mod97(account.replace(" ", "")):
                yield m.start(), m.start() + len(account), "iban"
                break
            account = account.rpartition(" ")[0]


def score(text: str, start: int, end: int, kind: str) -> float:
    """0 to 1: the kind's prior, moved by words standing near the span."""
    near = re.findall(r"[^\W\d_]+", (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower())
    value = PRIOR[kind]
    if any(w in CONTEXT[kind] for w in near):
        value += 0.2
    if any(w in AGAINST for w in near):
        value -= 0.35
    return min(1.0, max(0.0, round(value, 4)))


def find(text: str) -> list[tuple[int, int, str, float]]:
    """Spans (start, end, kind, score) by start, then kind. Base kinds stay whatever their score;
    the method's own kinds need `KEPT_SCORE`."""
    spans = [(s, e, k, score(text, s, e, k)) for s, e, k in proposals(text)]
    kept = [x for x in spans if x[2] in BASE_KINDS or x[3] >= KEPT_SCORE]
    return sorted(kept, key=lambda x: (x[0], KINDS.index(x[2])))


SPAN_SCHEMA = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id and its spans, ordered by start and kind.

    NULL and empty texts have none. Repeated rows are searched each; other columns are ignored;
    an empty table gives an empty result. Texts are searched whole, one slice of rows at a time."""

    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            rows = [
                [{"kind": k, "start": s, "end": e, "score": x} for s, e, k, x in find(t or "")] for t in part.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(run, SPAN_SCHEMA)


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of spans: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and
    the method's n_iban and max_score."""
    text = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    base = f"filter(spans, x -> x.kind IN ({', '.join(repr(k) for k in BASE_KINDS)}))"
    return found.selectExpr(
        "doc_id",
        *[f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS BIGINT) AS n_{k}" for k in BASE_KINDS],
        f"sha2({text.format(base)}, 256) AS base_sha256",
        f"{text.format('spans')} AS spans",
        "CAST(size(filter(spans, x -> x.kind = 'iban')) AS BIGINT) AS n_iban",
        "array_max(transform(spans, x -> x.score)) AS max_score",
    )
