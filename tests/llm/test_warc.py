import base64
import hashlib
import random

from filescape.llm import warc
from filescape.session import shared_path

PAGES = "page_id bigint, url string, html string, digest string, head int, copy int"


def round_trip(spark, cut, rows, **options):
    path = shared_path(spark, "warc")
    warc.write_archive(spark.createDataFrame([(*row, "d", 1, 2) for row in rows], PAGES), path, cut, **options)
    records = warc.read_records(warc.read_chunks(spark, path)).collect()
    assert all(r.intact for r in records)
    key = lambda row: tuple((x is None, x or "") for x in row)
    return sorted(((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=key), path


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_copies_nulls_and_repeats(spark, cut):
    rows = [(3, "http://a/", "x"), (1, None, "x"), (2, "u\r\nX: y", None), (4, "é", ""), (5, "b", "y"), (5, "b", "y"), (None, "c", "z"), (None, "c", "x")]
    found, _ = round_trip(spark, cut, rows)
    want = [
        ("1", 1, digest("x"), "response", None), ("2", 0, digest(""), "response", None), ("3", 1, digest("x"), "revisit", "1"),
        ("4", 0, digest(""), "revisit", "2"), ("5", 1, digest("y"), "response", None), ("5", 1, digest("y"), "revisit", "5"),
        (None, 1, digest("x"), "revisit", "1"), (None, 1, digest("z"), "response", None),
    ]
    assert found == sorted(want, key=lambda row: tuple((x is None, x or "") for x in row))


def test_chunks_follow_each_other(spark, cut):
    random.seed(3)
    mark = "\r\n\r\nWARC/1.1\r\n"
    bodies = ["ä" * 1000 + "€", mark * 3, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 4, "\r\n" * 40 + mark, "a" * 7]
    bodies += ["".join(random.choices(["\r", "\n", "WARC/1.1", "\r\n\r\n", "x", mark], k=30)) for _ in range(20)]
    rows = [(i, "u", body) for i, body in enumerate(bodies)]
    found, path = round_trip(spark, cut, rows, chunk_bytes=16, min_revisit_bytes=1 << 30)
    assert sorted((int(p), n, d) for p, n, d, _, _ in found) == [(i, len(b.encode()), digest(b)) for i, b in enumerate(bodies)]
    assert max(r[0] for r in warc.read_chunks(spark, path).selectExpr("length(chunk)").collect()) <= 16


def test_empty_table(spark, cut):
    assert round_trip(spark, cut, [])[0] == []


def test_base32(spark):
    values = [hashlib.sha1(bytes([i])).digest() for i in range(20)]
    df = spark.createDataFrame([(v.hex(), base64.b32encode(v).decode()) for v in values], "h string, b string")
    assert df.filter(warc.base32(df.h) != df.b).count() == 0
