"""WARC archives as a chunked record table.

A payload is cut into chunks of bounded size, and every chunk is a row (record, chunk
number, bytes, digest of the payload up to and including this chunk). Written out, a chunk
is a WARC segment: the first of a record is its `response`, later ones are `continuation`
records, as the format provides for oversized records. Neither writing nor reading holds
more of a record than a chunk beside the table value it came from, and any Hadoop file
system will do, because Spark's text source reads and writes the archives.

The text between two records, ``\\r\\n\\r\\nWARC/1.1\\r\\n``, is the line separator for
reading. It never occurs inside a segment: a payload that holds ``WARC/1.1`` is cut
after its first two bytes.

A null payload is empty, a null url gives a urn made of the id. Of equal payloads, empty
ones included, the record with the smallest id (nulls last) is the response and the others
are revisits of it; of rows that are equal in id and payload one is the response. With
`min_revisit_bytes`, shorter payloads are all responses. An empty table writes no record
and gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 64 << 10
BREAK = "\r\n\r\nWARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_MARK = re.compile(rb"WARC/1\.1")
_BATCH = 4 << 20


def base32(hex_digest: Column) -> Column:
    """A SHA-1 in hexadecimal as upper-case base 32: every five hex digits are four of 32."""
    four = lambda h, at: F.lpad(F.conv(F.substring(h, at, 5), 16, 32), 4, "0")
    places = F.array(*map(F.lit, range(1, 41, 5)))
    joined = F.transform(F.array(hex_digest), lambda h: F.array_join(F.transform(places, lambda at: four(h, at)), ""))
    return F.translate(joined[0], "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunks(payload: memoryview, size: int) -> Iterator[tuple[int, memoryview, bytes]]:
    """(number, bytes, digest of all bytes so far) of every chunk; an empty payload has one."""
    cuts = sorted({*range(0, len(payload), size), *(m.start() + 2 for m in _MARK.finditer(payload)), 0})
    digest = hashlib.sha1()
    for number, start in enumerate(cuts):
        stop = cuts[number + 1] if number + 1 < len(cuts) else len(payload)
        part = payload[start:stop]
        digest.update(part)
        yield number, part, digest.digest()


def plan_records(pages: DataFrame, cut, page="page_id", payload="html", min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, digest, copies, head, response): the rows that need more than one plain response.

    Payloads are not moved for this: only ids and digests are grouped.
    """
    digests = cut(
        pages.select(
            F.col(page).alias("page_id"),
            F.sha1(_payload(payload)).alias("digest"),
            F.octet_length(_payload(payload)).cast("long").alias("bytes"),
        ).filter(F.col("bytes") >= min_revisit_bytes)
    )
    own = digests.groupBy("page_id", "digest").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id")).alias("head")
    heads = digests.groupBy("digest").agg(first, F.count("*").alias("n")).filter("n > 1").drop("n")
    return cut(
        own.join(heads, "digest").select(
            "page_id",
            "digest",
            "copies",
            F.col("head.page_id").alias("head"),
            F.col("head.page_id").eqNullSafe(F.col("page_id")).alias("response"),
        ).filter(~F.col("response") | (F.col("copies") > 1))
    )


def _payload(payload: str) -> Column:
    return F.coalesce(F.col(payload), F.lit(""))


def write_archive(pages: DataFrame, path: str, cut, page="page_id", url="url", payload="html",
                  chunk_bytes: int = CHUNK_BYTES, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row below `path`, payloads of copies once.

    Files are compressed as a whole, so that a reader takes each from its beginning: a reader
    that starts inside a file cannot always tell where a separator begins.
    """
    special = plan_records(pages, cut, page, payload, min_revisit_bytes)
    rows = pages.select(
        F.col(page).alias("page_id"), F.col(url).cast("string").alias("url"), _payload(payload).alias("html"), F.sha1(_payload(payload)).alias("digest")
    )
    right = special.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "copies", "head", "response")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest"))
    marked = rows.join(right, same, "left")
    plain = marked.filter("copies is null").select(
        "page_id", "url", F.col("html").cast("binary").alias("html"), "digest", F.lit(True).alias("response"),
        F.lit(None).cast(rows.schema["page_id"].dataType).alias("head"), F.lit(0).alias("copy"),
    )
    # of equal rows the payload is kept once, the others are revisits
    heads = marked.filter("response").groupBy("page_id", "digest").agg(
        F.min("url").alias("url"), F.first("html").alias("html"), F.first("copies").alias("copies"), F.first("head").alias("head")
    )
    heads = heads.select("*", F.explode(F.expr("sequence(0, cast(copies as int) - 1)")).alias("copy")).select(
        "page_id", "url", F.when(F.col("copy") == 0, F.col("html").cast("binary")).otherwise(F.lit("").cast("binary")).alias("html"),
        "digest", (F.col("copy") == 0).alias("response"), "head", "copy",
    )
    revisits = marked.filter("not response").select(
        "page_id", "url", F.lit("").cast("binary").alias("html"), "digest", F.lit(False).alias("response"), "head", F.lit(0).alias("copy"),
    )
    records = plain.unionByName(heads).unionByName(revisits).withColumn("digest", base32(F.col("digest")))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            for row in range(batch.num_rows):
                value = {name: column[name][row].as_py() for name in ("page_id", "url", "digest", "response", "head", "copy")}
                body = memoryview(column["html"][row].as_buffer())
                for segment in _segments(value, body, chunk_bytes, date):
                    held.append(segment)
                    size += len(segment)
                    if size >= _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    out = records.mapInArrow(segments, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _segments(row: dict, body: memoryview, chunk_bytes: int, date: str) -> Iterator[bytes]:
    name = "null" if row["page_id"] is None else str(row["page_id"])
    base = f"urn:page:{name}:{row['digest']}:{row['copy']}"
    target = quote(row["url"], safe=":/?#[]@!$&'()*+,;=%~-._") if row["url"] else f"urn:page:{name}"
    always = {"WARC-Date": date, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{row['digest']}", "X-Page-ID": name}
    if not row["response"]:
        head = "null" if row["head"] is None else str(row["head"])
        fields = {
            "WARC-Type": "revisit", "WARC-Record-ID": f"<{base}:0>", **always, "WARC-Refers-To": f"<urn:page:{head}:{row['digest']}:0:0>",
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": head,
        }
        yield _record(fields, b"")
        return
    total = len(HTTP) + len(body)
    parts = chunks(body, chunk_bytes)
    ahead = next(parts)
    while ahead:
        number, part, so_far = ahead
        ahead = next(parts, None)
        block = (HTTP if number == 0 else b"") + bytes(part)
        fields = {
            "WARC-Type": "continuation" if number else "response", "WARC-Record-ID": f"<{base}:{number}>", **always,
            "WARC-Block-Digest": f"sha1:{_b32(hashlib.sha1(block).digest())}", "WARC-Segment-Number": number + 1,
            "X-Digest-So-Far": _b32(so_far), "X-Segments": "last" if ahead is None else "more",
            "Content-Type": "application/http; msgtype=response",
        }
        if number:
            fields["WARC-Segment-Origin-ID"] = f"<{base}:0>"
        if ahead is None and number:
            fields["WARC-Segment-Total-Length"] = total
        yield _record(fields, block)


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(fields: dict, block: bytes) -> bytes:
    lines = "".join(f"{key}: {value}\r\n" for key, value in {**fields, "Content-Length": len(block)}.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of archives: a row per segment, in no order.

    record, page (text of the id, null for none), record_type, refers_to (likewise),
    stated_digest, chunk_no, last, chunk, digest_so_far (as stated).
    """
    lines = spark.read.option("lineSep", BREAK).text(path)
    text = F.regexp_replace(F.expr("substring(value, 1, instr(value, '\\r\\n\\r\\n') + 1)"), r"^WARC/1\.1\r\n", "")
    skipped = F.when(F.startswith("value", F.lit("WARC/1.1\r\n")), 10).otherwise(0)
    parsed = lines.select(
        text.alias("head"), (F.octet_length(text) + skipped + 2).alias("at"), F.col("value").cast("binary").alias("raw")
    )
    field = lambda key: F.nullif(F.regexp_extract("head", rf"(?m)^{key}: ([^\r\n]*)$", 1), F.lit(""))
    kind = field("WARC-Type")
    block = F.expr("substring(raw, at + 1, cast(length as int))")
    return (
        parsed.withColumn("length", field("Content-Length"))
        .select(
            F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record"),
            F.nullif(field("X-Page-ID"), F.lit("null")).alias("page"),
            kind.alias("record_type"),
            F.when(kind == "revisit", F.nullif(field("X-Refers-To-Page"), F.lit("null"))).alias("refers_to"),
            F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"),
            (F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)) - 1).alias("chunk_no"),
            (F.coalesce(field("X-Segments"), F.lit("last")) == "last").alias("last"),
            field("X-Digest-So-Far").alias("digest_so_far"),
            block.alias("block"),
        )
        .withColumn("chunk", F.when(F.col("record_type") == "response", F.expr(f"substring(block, {len(HTTP) + 1}, length(block))")).otherwise(F.col("block")))
        .drop("block")
    )


def read_records(chunk_rows: DataFrame) -> DataFrame:
    """A row per record: page, record_type, refers_to, payload_bytes, payload_digest, intact.

    Bytes and digests of responses are computed from their chunks: at once where there is
    one, else chunk by chunk in order, carrying the digest along. Those of revisits are the
    response's. `intact` tells whether all agree with what the archive states.
    """
    columns = ["record", "page", "record_type", "refers_to", "stated_digest"]
    single = (F.col("chunk_no") == 0) & F.col("last")
    first = F.col("record_type") == "response"
    whole = chunk_rows.filter(first & single).select(
        "record", "page", "stated_digest", F.octet_length("chunk").cast("long").alias("payload_bytes"), base32(F.sha1("chunk")).alias("payload_digest")
    )
    # the rows of a record follow each other, so one digest is enough
    cut_up = chunk_rows.filter((F.col("record_type") != "revisit") & ~single)
    rows = cut_up.select("record", "page", "stated_digest", "chunk_no", "last", "digest_so_far", "chunk")
    joined = rows.repartition("record").sortWithinPartitions("record", "chunk_no").mapInArrow(
        _follow, "record string, page string, stated_digest string, payload_bytes bigint, payload_digest string"
    )
    responses = whole.unionByName(joined).select(
        "page", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), "payload_bytes", "payload_digest",
        (F.col("payload_digest") == F.col("stated_digest")).alias("intact"), "record",
    )
    sizes = responses.filter("intact").select(F.col("payload_digest").alias("_digest"), "payload_bytes").groupBy("_digest").agg(
        F.min("payload_bytes").alias("payload_bytes")
    )
    revisits = chunk_rows.filter("record_type = 'revisit'").select(*columns).join(
        sizes, F.col("stated_digest") == F.col("_digest"), "left"
    ).select(
        "page", "record_type", "refers_to", "payload_bytes", F.col("stated_digest").alias("payload_digest"),
        F.col("payload_bytes").isNotNull().alias("intact"), "record",
    )
    return responses.unionByName(revisits).drop("record")


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record", "page", "stated_digest", "payload_bytes", "payload_digest"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    digest, size, expected = hashlib.sha1(), 0, 0
    for batch in batches:
        done = []
        for row in range(batch.num_rows):
            number = batch.column("chunk_no")[row].as_py()
            if number == 0:
                digest, size, expected = hashlib.sha1(), 0, 0
            part = batch.column("chunk")[row].as_buffer()
            digest.update(part)
            size += part.size
            record = batch.column("record")[row].as_py()
            if number != expected or _b32(digest.digest()) != batch.column("digest_so_far")[row].as_py():
                raise ValueError(f"chunk {number} of {record} does not follow chunk {expected - 1}")
            expected += 1
            if batch.column("last")[row].as_py():
                done.append((record, batch.column("page")[row].as_py(), batch.column("stated_digest")[row].as_py(), size, _b32(digest.digest())))
        arrays = [pa.array(column, kind) for column, kind in zip(zip(*done) if done else [[]] * 5, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names)
