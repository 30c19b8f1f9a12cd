"""WARC archives: exact round trips, and what the reader does with damaged ones."""

import hashlib

import pytest

from boutline.llm import warc

SCHEMA = "page_id long, url string, html string"
BIG = "x" * 10 + "WARC/1.1\r\n\r\n\r\n" + "é" * 30_000 + "WARC/1.1\r\nWARC/1.1\r\n"
ROWS = [
    (5, "u5", BIG), (3, "u3", BIG), (3, "u3", BIG), (None, None, BIG), (1, "a\r\nb c", "short"), (2, "x", "short"), (2, "x", "short"),
    (7, None, None), (8, "y", ""), (9, "z", "q" * 99), (10, "z", "q" * 99), (11, "z", "q" * 100), (10, "z", "q" * 100),
    (None, "n", "q" * 100), (12, "k", "0\r\n\r\n" * 5000), (13, "k", "中" * 20_000),
]


def expected(rows):
    rank = lambda p, u: (p is None, p or 0, u is None, u or "")
    first = {}
    for page, url, html in rows:
        first[html] = min(first.get(html, rank(page, url)), rank(page, url))
    out, used = [], set()
    for page, url, html in rows:
        payload = (html or "").encode()
        response = len(payload) < 100 or (first[html] == rank(page, url) and html not in used)
        used |= {html} if response else set()
        target = None if response or first[html][0] else first[html][1]
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "response" if response else "revisit", target))
    return sorted(out, key=str)


def rows_of(df):
    rows = df.collect()
    assert all(r.problem is None for r in rows), [r for r in rows if r.problem]
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


@pytest.mark.parametrize("segment_bytes", [16_384, 1000])
def test_round_trip(spark, segment_bytes):
    pages = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "page_id AS record_id", "url AS kind", "url AS digest", "1 AS first", "html AS record")
    assert rows_of(warc.round_trip(pages, segment_bytes)) == expected(ROWS)


def test_segments_of_few_bytes_and_files_cut_anywhere(spark, tmp_path):
    rows = [r for r in ROWS if r[2] != BIG and r[0] not in (12, 13)] + [(20, "v", "WARC/1.1\r\n" * 30)]
    path = str(tmp_path / "archive")
    records = warc.page_records(spark.createDataFrame(rows, SCHEMA)).mapInArrow(lambda b: warc._records(b, 7), "record binary")
    records.selectExpr("CAST(record AS STRING) AS value").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
    try:
        assert rows_of(warc.read_archives(spark, path)) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_tables(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_framing():
    for body in (b"", b"a", b"0\r\n\r\n" * 9, b"WARC/1.1\r\n" * 5, bytes(range(256)) * 40):
        framed = warc.chunked(body, 100)
        assert warc.unchunked(framed) == body and warc.VERSION.encode() not in framed
    assert warc.unchunked(b"5;name=x\r\nhello\r\n0\r\nTrailer: 1\r\n\r\n") == b"hello"
    for broken in (b"", b"5\r\nhel", b"zz\r\nhello\r\n0\r\n\r\n", b"5\r\nhelloXX0\r\n\r\n"):
        assert warc.unchunked(broken) is None
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain" and warc.payload_of(b"no head") is None


def record(kind, record_id, block, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": len(block)}
    return warc.VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n" + block + "\r\n\r\n"


def test_damaged_archives_are_reported(spark, tmp_path):
    http = "HTTP/1.1 200 OK\r\n\r\n"
    whole = record("response", "<r1>", http + "body", X_Page_ID=1)
    parts = [
        record("response", "<r2>", http + "ab", X_Page_ID=2, WARC_Segment_Number=1),
        record("continuation", "<c3>", "ef", WARC_Segment_Origin_ID="<r2>", WARC_Segment_Number=3, WARC_Segment_Total_Length=len(http) + 6),
        record("continuation", "<c2>", "cd", WARC_Segment_Origin_ID="<r2>", WARC_Segment_Number=2),
    ]
    gap = [
        record("response", "<r3>", http, X_Page_ID=3, WARC_Segment_Number=1),
        record("continuation", "<d3>", "x", WARC_Segment_Origin_ID="<r3>", WARC_Segment_Number=3, WARC_Segment_Total_Length=len(http) + 1),
    ]
    short = [
        record("response", "<r4>", http, X_Page_ID=4, WARC_Segment_Number=1),
        record("continuation", "<e2>", "x", WARC_Segment_Origin_ID="<r4>", WARC_Segment_Number=2, WARC_Segment_Total_Length=999),
    ]
    wrong = record("response", "<r5>", http + "q", X_Page_ID=5, WARC_Payload_Digest="sha256:" + "0" * 64)
    cut = record("response", "<r6>", http + "long", X_Page_ID=6).replace("long\r\n\r\n", "lo")
    lost = record("revisit", "<v7>", "", X_Page_ID=7, WARC_Refers_To="<none>", WARC_Payload_Digest="sha256:" + "1" * 64)
    orphan = record("continuation", "<c8>", "x", WARC_Segment_Origin_ID="<r8>", WARC_Segment_Number=2, WARC_Segment_Total_Length=9)
    info = record("warcinfo", "<i>", "software: other")
    text = info + whole + "".join(parts + gap + short) + wrong + lost + orphan + cut
    (tmp_path / "x.warc").write_bytes(text.encode())
    got = {r.page_id: (r.problem, r.payload_bytes) for r in warc.read_archives(spark, str(tmp_path / "x.warc")).collect()}
    assert got == {
        1: (None, 4),
        2: (None, 6),
        3: ("segments are missing or repeated", None),
        4: ("total length does not match", None),
        5: ("digest does not match", 1),
        6: ("cut short", None),
        7: ("its response is missing", None),
        None: ("first segment is missing", None),
    }
