"""WARC archives: writing pages as transactions, reading records, and assembling transactions.

A capture is a response or revisit record with the request and metadata records that name it
as concurrent. Archives are written by Spark's own text writer, whose line separator is
the end mark of a record, so they go to whatever store the path names. They are read whole,
one bounded file at a time, by a parser that goes by the records' lengths, and the records
are joined through their concurrent-to identifiers, in one nested row for each capture.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = pa.schema(
    [
        ("record_id", pa.string()),
        ("warc_type", pa.string()),
        ("target_uri", pa.string()),
        ("warc_date", pa.string()),
        ("concurrent_to", pa.string()),
        ("refers_to", pa.string()),
        ("named_digest", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("block", pa.binary()),
    ]
)
RECORDS_SQL = (
    "record_id string, warc_type string, target_uri string, warc_date string, concurrent_to string, refers_to string, "
    "named_digest string, payload_digest string, payload_bytes long, block binary"
)


def _urn(*parts: Column) -> Column:
    """A UUID URN made from a hash of the parts, nulls included."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for n, (at, size) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] * bool(n) + [F.substring(h, at, size)])], F.lit(">"))


def _record(kind: str, identifier: Column, url: Column, date: str, content_type: str, block: Column, *more: Column) -> Column:
    lines = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {date}\r\nWARC-Record-ID: "),
        identifier,
        F.lit("\r\nWARC-Target-URI: "),
        url,
        *more,
        F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
        block,
    ]
    return F.concat(*lines)


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``(page_id, original)`` of pages whose payload, of ``least_bytes`` at least, is that of a page with a larger id.

    From ``pages(page_id, digest, n)``. Each group's largest id is found before any join, and
    only groups with two different ids are joined with their pages.
    """
    large = pages.where(F.col("n") >= least_bytes).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("original"), F.min("page_id").alias("other")).where("original <> other")
    # Written before it is made distinct, the join can be split where one payload has very many pages.
    met = shared.settled(large.join(groups.select("digest", "original"), "digest").where("page_id <> original").select("page_id", "original"))
    return met.distinct()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1_000, file_bytes: int = 24_000_000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes three records for each row of ``pages(page_id, url, html)`` into gzip files of about ``file_bytes`` before compression under ``folder``.

    Files hold as many records as pages of mean size would fill; pages over 16 times that size have
    files of their own, so that a file is never larger than 16 times ``file_bytes`` or one page.

    The payload is the html in UTF-8; a null one is empty, a null url becomes ``urn:none``.
    Among equal payloads of ``least_bytes`` or more the largest page_id is the response and
    the others revisit it; rows repeated in that id are all responses. Smaller payloads and
    rows without an id are responses.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\r\n]", "").alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    mean, most = rows.agg(F.coalesce(F.avg("n"), F.lit(0.0)), F.coalesce(F.max("n"), F.lit(0))).first()
    vast = 16 * (mean + 1_500)
    met = revisits(rows.select("page_id", "digest", "n"), least_bytes)
    again = F.col("original").isNotNull() & (F.col("n") >= least_bytes)
    own = _urn(F.lit("capture"), F.col("page_id"), F.col("digest"), F.col("copy"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    digest = F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"))
    concurrent = F.concat(F.lit("\r\nWARC-Concurrent-To: "), own)
    path = F.regexp_replace("url", r"^[a-z]+://[^/?#]*", "")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    request = F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    original = _urn(F.lit("capture"), F.col("original"), F.col("digest"), F.lit(1))
    url, http = F.col("url"), "application/http; msgtype="
    capture = F.when(
        again,
        _record("revisit", own, url, date, http + "response", head, digest, F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), original),
    ).otherwise(_record("response", own, url, date, http + "response", F.concat(head, F.col("payload")), digest))
    records = F.array(
        capture,
        _record("request", _urn(F.lit("request"), F.col("page_id"), F.col("digest"), F.col("copy")), url, date, http + "request", request, concurrent),
        _record("metadata", _urn(F.lit("metadata"), F.col("page_id"), F.col("digest"), F.col("copy")), url, date, "application/warc-fields", fields, concurrent),
    )
    per_file = max(3, 3 * int(file_bytes / (mean + 1_500)))
    parts = [(F.col("n") <= vast, per_file), (F.col("n") > vast, 3)] if most > vast else [(F.lit(True), per_file)]
    for chosen, records_per_file in parts:
        # Equal payloads are equally long, so what belongs together is in one part, and each page is moved once.
        known = rows.where(chosen).join(met, "page_id", "left")
        # Rows repeated in id and payload are told apart by their number.
        known = known.withColumn("copy", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")))
        lines = known.select(F.explode(records).alias("value"))
        lines.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(folder)


def parse(content: bytes, keep_blocks: bool) -> Iterator[tuple]:
    """Records of an archive, compressed or not, by their lengths. Raises ValueError where a record doesn't begin."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = end + 4
        block = content[begin : begin + int(fields["content-length"])]
        at = begin + len(block) + 4
        kind = fields.get("warc-type")
        payload = block
        if fields.get("content-type", "").startswith("application/http"):
            payload = block[block.find(b"\r\n\r\n") + 4 :]
        digest = hashlib.sha1(payload).hexdigest() if kind == "response" else None
        kept = block if keep_blocks or kind in ("request", "metadata") else None
        yield (
            fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-concurrent-to"),
            fields.get("warc-refers-to"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, digest, len(payload) if kind == "response" else None, kept,
        )


def read_records(spark: SparkSession, folder: str, keep_blocks: bool = True, batch: int = 256) -> DataFrame:
    """All records of the archives under ``folder``; without ``keep_blocks`` captures' blocks are left out once measured."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for content in one.column("content"):
                found: list[tuple] = []
                for record in parse(content.as_py(), keep_blocks):
                    found.append(record)
                    if len(found) == batch:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), RECORDS.types, strict=True)], schema=RECORDS)
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), RECORDS.types, strict=True)], schema=RECORDS)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(rows, RECORDS_SQL)


def assemble(records: DataFrame) -> DataFrame:
    """A row for each response or revisit record: its columns as ``capture``, with ``request`` and ``metadata`` records nested.

    A record belongs to a capture if either names the other as concurrent, and metadata also if
    it names such a request. Of several requests, or metadata records, the smallest id is
    taken. Captures without them have nulls there; records without a capture have no row.
    """
    is_capture = F.col("warc_type").isin("response", "revisit")
    captures = records.where(is_capture)
    others = records.where(F.col("warc_type").isin("request", "metadata"))
    ids = captures.select(F.col("record_id").alias("capture_id"), F.col("concurrent_to").alias("named"))
    names = others.select("record_id", "concurrent_to")
    forward = names.join(ids.select("capture_id"), F.col("concurrent_to") == F.col("capture_id")).select("record_id", "capture_id")
    backward = ids.where("named IS NOT NULL").join(names, F.col("named") == F.col("record_id")).select("record_id", "capture_id")
    direct = forward.unionByName(backward).distinct()
    indirect = names.join(direct.withColumnRenamed("record_id", "via"), F.col("concurrent_to") == F.col("via")).select("record_id", "capture_id")
    member = direct.unionByName(indirect).distinct()
    nested = others.join(member, "record_id").select("capture_id", "warc_type", F.struct(*[F.col(c) for c in others.columns]).alias("r"))
    by_kind = [F.min_by(F.when(F.col("warc_type") == k, F.col("r")), F.when(F.col("warc_type") == k, F.col("r.record_id"))).alias(k) for k in ("request", "metadata")]
    grouped = nested.groupBy("capture_id").agg(*by_kind)
    whole = captures.select(F.struct(*[F.col(c) for c in captures.columns]).alias("capture"))
    return whole.join(grouped, F.col("capture.record_id") == F.col("capture_id"), "left").drop("capture_id")


def op6(spark, sf_dir):
    folder = shared.own_folder(spark, "warc")
    write_archives(shared.table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    transactions = assemble(shared.settled(read_records(spark, folder, keep_blocks=False)))
    page = F.regexp_extract(F.col("metadata.block").cast("string"), r"page-id: (-?\d+)", 1)
    rows = shared.settled(transactions.select("capture.*", page.try_cast("long").alias("page_id")))
    shape = lambda df, original: df.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), original.alias("refers_to"))
    # A revisit's payload is that of the response that it refers to.
    originals = rows.where("warc_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("original"), "payload_digest", "payload_bytes")
    again = rows.where("warc_type = 'revisit'").select("page_id", "warc_type", "refers_to").join(originals, "refers_to", "left")
    return shape(rows.where("warc_type = 'response'"), F.lit(None).cast("long")).unionByName(shape(again, F.col("original")))


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> original THEN original END AS refers_to
FROM p LEFT JOIN g USING (d)
"""
