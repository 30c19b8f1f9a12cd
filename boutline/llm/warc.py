"""WARC archives of web pages: writing with Spark's text writer, reading with segment reassembly.

A record's block is an HTTP response whose body has chunked transfer framing. Blocks longer than
a segment go out as a first record and continuation records; the reader groups continuations by
the record they continue, orders them by segment number, verifies the total length and takes the
framing off. Payloads that occur more than once are stored once: later pages revisit the first.

Records begin with the line `WARC/1.1`, at which the text reader splits; files may be cut anywhere
between executors. The writer's chunk borders break that line wherever a payload holds it. In an
archive of another writer a payload that holds it makes a record whose length does not verify; it
is reported in `problem`, never passed on as sound."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.session import fresh_path, materialise

LEAST_REVISIT = 100  # bytes of payload from which equal ones are stored once
CHUNK_BYTES = 4096
SEGMENT_BYTES = 16_384
FILE_RECORDS = 100_000  # per archive file
SLICE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of capture
VERSION = "WARC/1.1\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


# ------------------------------------------------------------------ framing


def chunked(body: bytes, most: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing, with a border inside every version line that the body holds."""
    borders = {*range(0, len(body), most), len(body)}
    borders.update(m.start() + 4 for m in re.finditer(re.escape(VERSION.encode()), body))
    cuts = sorted(borders)
    chunks = [b"%x\r\n%b\r\n" % (end - start, body[start:end]) for start, end in zip(cuts, cuts[1:])]
    return b"".join(chunks) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """What chunked framing holds; None if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = body[at:line].split(b";")[0].strip() if line >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        start, n = line + 2, int(size, 16)
        if not n:
            return b"".join(out)  # trailers may follow
        if body[start + n : start + n + 2] != b"\r\n":
            return None
        out.append(body[start : start + n])
        at = start + n + 2


def payload_of(block: bytes) -> bytes | None:
    """Payload of an HTTP response: what follows its head, without chunked framing."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head) else body


def segments(block: bytes, most: int = SEGMENT_BYTES) -> list[bytes]:
    return [block[i : i + most] for i in range(0, len(block), most)] or [b""]


# ------------------------------------------------------------------ writing


def _urn(*cols: Column) -> Column:
    """A record id from what identifies the record: 128 bits."""
    digest = F.md5(F.concat_ws("\n", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]))
    parts = [F.substring(digest, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _records(batches: Iterator[pa.RecordBatch], segment_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row a record, as it stands in an archive."""
    names = ("record_id", "kind", "page_id", "url", "digest", "refers_to", "html")
    out: list[bytes] = []
    size = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    for batch in batches:
        for record_id, kind, page_id, url, digest, refers_to, html in zip(*[batch.column(n).to_pylist() for n in names]):
            block = HTTP_HEAD + chunked((html or "").encode()) if kind == "response" else HTTP_HEAD
            pieces = segments(block, segment_bytes)
            for number, piece in enumerate(pieces, 1):
                first = number == 1
                own = record_id if first else record_id[:-1] + f":{number}>"
                head = [f"WARC-Type: {kind if first else 'continuation'}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}"]
                if first:
                    head += [f"X-Page-ID: {page_id}"] * (page_id is not None)
                    head += [f"WARC-Target-URI: {url}"] * (url is not None)
                    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
                    head += [f"WARC-Refers-To: {refers_to}"] * (refers_to is not None)
                    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] * (kind == "revisit")
                else:
                    head += [f"WARC-Segment-Origin-ID: {record_id}"]
                if len(pieces) > 1:
                    head += [f"WARC-Segment-Number: {number}"]
                    head += [f"WARC-Segment-Total-Length: {len(block)}"] * (number == len(pieces))
                head += [f"Content-Length: {len(piece)}"]
                out.append(VERSION.encode() + "\r\n".join(head).encode() + b"\r\n\r\n" + piece)
                size += len(piece)
                if size >= SLICE_BYTES:
                    yield flush()
                    out, size = [], 0
    if out:
        yield flush()


def page_records(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): record_id, kind, page_id, url, digest,
    refers_to, html (of responses only).

    Of rows with equal payloads of `least_revisit` bytes or more the one with the smallest page_id
    (NULL last, then the smallest url) is the response, the others revisit it. Only one row per
    distinct payload carries its text through the shuffle; what is joined by digest is narrow."""
    raw = pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "CAST(url AS STRING) AS url", "coalesce(CAST(html AS STRING), '') AS html")
    raw = raw.withColumn("url", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"))  # a header is one line
    long = F.octet_length("html") >= least_revisit
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    first = raw.where(long).groupBy("html").agg(F.min(rank).alias("first"))
    digest = F.sha2("html", 256).alias("digest")
    first = first.select(digest, "first.page_id", "first.url", "html").withColumn("copy", F.lit(1))
    # The same rows without texts: a second shuffle of them would cost as much as the first.
    heads = raw.where(long).select(digest, rank.alias("rank")).groupBy("digest").agg(F.min("rank").alias("first"))
    heads = heads.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    # Equal rows are counted, then told apart by a number.
    counted = raw.groupBy("page_id", "url", digest, F.when(long, F.lit(None)).otherwise(F.col("html")).alias("html")).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    short = rows.where("html IS NOT NULL").select("page_id", "url", "digest", "copy", "html")
    later = rows.where("html IS NULL").join(heads, "digest")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("copy") == 1)
    later = later.where(~is_first)
    own = _urn(F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy"))
    response = first.select("digest", "page_id", "url", "copy", "html").unionByName(short)
    response = response.select(own.alias("record_id"), F.lit("response").alias("kind"), "page_id", "url", "digest", F.lit(None).cast("string").alias("refers_to"), "html")
    origin = _urn(F.col("first_id"), F.col("first_url"), F.col("digest"), F.lit(1))
    revisit = later.select(own.alias("record_id"), F.lit("revisit").alias("kind"), "page_id", "url", "digest", origin.alias("refers_to"), F.lit(None).cast("string").alias("html"))
    return response.unionByName(revisit)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, least_revisit: int = LEAST_REVISIT) -> None:
    """Write `pages` as gzipped WARC files under `path`, which must not exist."""
    records = page_records(pages, least_revisit).mapInArrow(lambda batches: _records(batches, segment_bytes), "record binary")
    writer = records.select(F.col("record").cast("string").alias("value")).write
    writer.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


# ------------------------------------------------------------------ reading

FIELDS = {
    "WARC-Record-ID": "record_id", "WARC-Type": "kind", "X-Page-ID": "page_id", "WARC-Target-URI": "url", "WARC-Payload-Digest": "digest",
    "WARC-Refers-To": "refers_to", "WARC-Segment-Origin-ID": "origin", "WARC-Segment-Number": "number", "WARC-Segment-Total-Length": "total",
    "Content-Length": "length",
}
_BY_NAME = {k.lower().encode(): v for k, v in FIELDS.items()}
_INTEGERS = {"page_id", "number", "total", "length"}
HEAD_SCHEMA = "record_id string, kind string, page_id long, url string, digest string, refers_to string, origin string, number long, total long"
DONE_SCHEMA = "payload_bytes long, payload_digest string, problem string"


def parse_record(record: bytes) -> tuple[dict, bytes]:
    """Header fields, and the block; `problem` says why a record cannot be used."""
    head, _, rest = record.partition(b"\r\n\r\n")
    row: dict = dict.fromkeys(FIELDS.values()) | {"problem": None}
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        field = _BY_NAME.get(name.strip().lower())
        if field:
            shown = value.strip().decode("utf-8", "replace")
            if field not in _INTEGERS:
                row[field] = shown
            elif re.fullmatch(r"[+-]?[0-9]{1,18}", shown):
                row[field] = int(shown)
            else:
                row["problem"] = f"{field} is no number"
    length = row["length"]
    if length is None or length < 0:
        row["problem"] = row["problem"] or "no length"
        return row, b""
    if rest[length:] not in (b"\r\n\r\n", b""):
        row["problem"] = row["problem"] or "length does not match"
    elif len(rest) < length:
        row["problem"] = row["problem"] or "cut short"
    return row, rest[:length]


def _finished(row: dict, block: bytes) -> dict:
    """Payload size and digest of a whole block, checked against the record's own digest."""
    payload = payload_of(block) if row["problem"] is None else None
    if payload is None:
        return row | {"payload_bytes": None, "payload_digest": None, "problem": row["problem"] or "framing is broken"}
    digest = hashlib.sha256(payload).hexdigest()
    stated = row["digest"]
    wrong = stated is not None and stated.lower().startswith("sha256:") and stated[7:].lower() != digest
    return row | {"payload_bytes": len(payload), "payload_digest": digest, "problem": "digest does not match" if wrong else None}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under `path` (plain or gzipped): header fields, and for
    responses that are whole in one record the payload's size and digest; blocks of segmented
    records stay in `block` for `reassemble`."""
    lines = spark.read.option("lineSep", VERSION).text(path).where("value <> ''")
    ddl = f"{HEAD_SCHEMA}, {DONE_SCHEMA}, block binary"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for value in batch.column("record"):
                record = value.as_py()
                row, block = parse_record(record)
                segmented = row["number"] is not None or row["kind"] == "continuation"
                if segmented:
                    row |= {"block": block}
                elif row["kind"] == "response":
                    row = _finished(row, block)
                out.append(row)
                size += len(block) if segmented else 0
                if size >= SLICE_BYTES or len(out) >= 10_000:
                    yield _batch(out, schema)
                    out, size = [], 0
        if out:
            yield _batch(out, schema)

    return lines.select(F.col("value").cast("binary").alias("record")).mapInArrow(run, ddl)


def reassemble(records: DataFrame) -> DataFrame:
    """Segmented records of `read_records` put together: continuations by the record they continue,
    in the order of their numbers. The numbers must run from 1 without a gap, and the lengths must
    add up to the total that the last one states."""
    parts = records.where("number IS NOT NULL OR kind = 'continuation'")
    origin = F.when(F.col("kind") == "continuation", F.col("origin")).otherwise(F.col("record_id"))
    parts = parts.select("*", origin.alias("whole")).where("whole IS NOT NULL")
    heads = [f.split()[0] for f in HEAD_SCHEMA.split(", ")]
    piece = F.struct("number", "total", "problem", "block")
    first = F.max(F.when(F.col("kind") != "continuation", F.struct(*heads))).alias("first")
    groups = parts.groupBy("whole").agg(first, F.sort_array(F.collect_list(piece)).alias("pieces"))
    groups = groups.select("whole", *[f"first.{h}" for h in heads if h not in ("number", "total")], "pieces")
    kept = [h for h in heads if h not in ("number", "total")]
    ddl = ", ".join([f for f in HEAD_SCHEMA.split(", ") if f.split()[0] in kept]) + f", {DONE_SCHEMA}"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                pieces, whole = row.pop("pieces"), row.pop("whole")
                block = b"".join(p["block"] or b"" for p in pieces)
                problem = next((p["problem"] for p in pieces if p["problem"]), None)
                if row["record_id"] is None:
                    row["record_id"], problem = whole, "first segment is missing"
                elif [p["number"] for p in pieces] != list(range(1, len(pieces) + 1)):
                    problem = problem or "segments are missing or repeated"
                elif pieces[-1]["total"] != len(block):
                    problem = problem or "total length does not match"
                out.append(_finished(row | {"problem": problem}, block))
            if out:
                yield _batch(out, schema)

    return groups.mapInArrow(run, ddl)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of the archives under `path`: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to (page_id of the response that a revisit names), problem (NULL: sound).

    A revisit takes size and digest from its response; if that is missing, broken or has another
    digest, `problem` says so. An archive without records gives an empty result."""
    records = materialise(read_records(spark, path), "warc_records")
    columns = ["record_id", "page_id", "url", "payload_bytes", "payload_digest", "problem"]
    whole = records.where("kind = 'response' AND number IS NULL").select(columns)
    together = reassemble(records).where("kind = 'response' OR kind IS NULL").select(columns)
    responses = materialise(whole.unionByName(together), "warc_responses")
    target = responses.select(
        F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes"), F.col("payload_digest"),
        F.col("problem").alias("broken"), F.lit(True).alias("there"),
    )
    revisits = records.where("kind = 'revisit'").select("page_id", "url", "digest", F.col("refers_to").alias("refers"), "problem")
    found = revisits.join(target, "refers", "left")
    same = F.col("digest") == F.concat(F.lit("sha256:"), "payload_digest")
    problem = F.coalesce(
        "problem",
        F.when(F.col("there").isNull(), "its response is missing").when(F.col("broken").isNotNull(), "its response is broken").when(~same, "digest does not match"),
    )
    out = ["page_id", "url", "payload_bytes", "payload_digest"]
    revisits = found.select(*out, F.lit("revisit").alias("record_type"), "refers_to", problem.alias("problem"))
    plain = responses.select(*out, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "problem")
    return plain.unionByName(revisits)


def round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """`pages` (page_id, url, html) written as archives to the shared folder and read back, see
    `read_archives`: one row per row of `pages`.

    A NULL html is an empty payload, a NULL page_id or url leaves its header out, repeated rows are
    records of their own, other columns are ignored, an empty table gives an empty result."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc_archives")
    write_archives(pages, path, segment_bytes, least_revisit)
    return read_archives(spark, path)
