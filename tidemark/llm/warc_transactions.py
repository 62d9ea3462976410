"""Web archives: writing captures as WARC records, reading them back, and assembling transactions.

A capture is a request, a response or revisit, and a metadata record. Request and metadata name the response in
WARC-Concurrent-To; joining on that gives one nested row per capture. Of captures with equal payloads one keeps the payload and
the others become revisit records that refer to it. Records travel through Spark's text sink and binary file source, so archives
can lie in any store that Spark reaches.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import Stored

REVISIT_BYTES = 1000  # smaller payloads are always stored
FILE_BYTES = 1 << 26  # of an archive, before compression and about; an archive is read in one piece
HEAD_BYTES = 400  # of a record, about
CRLF = "\r\n"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
DATE = "2024-01-01T00:00:00Z"


def _urn(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the two line ends behind it; a header whose value is null is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(l, F.lit("")) for l in lines], length, block)


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, record_id, refers_to): what each page's response record will be.

    A page that is there more than once gets numbered records. The page with the largest id of equal payloads of at least
    REVISIT_BYTES keeps the payload; ``refers_to`` is null for it and holds its record's id for the others.
    """
    number = F.col(page_id).cast("string")
    rows = pages.select(
        F.when(number.isNull(), "null").otherwise(F.concat(F.lit("="), number)).alias("key"), F.col(page_id).alias("id"),
        F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce(html, F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    # what becomes of a page is decided without its payload, and equal rows are one row until their records are made
    same = ["key", "url", "digest"]
    kinds = rows.groupBy(*same).agg(F.first("id").alias("id"), F.max(F.octet_length("payload")).alias("size"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("digest", "url")) - F.col("n")
    kinds = kinds.withColumn("copy", before)
    # of a repeated page the first copy: the smallest number wins among equal ids
    best = F.max(F.struct("id", (-F.col("copy")).alias("minus"), "key"))
    keepers = kinds.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(best.alias("keeper"))
    name = lambda k, c: _urn(F.lit("response"), k, c.cast("string"))
    kept = keepers.select("digest", name(F.col("keeper.key"), -F.col("keeper.minus")).alias("kept_id"))
    payloads = rows.groupBy(*same).agg(F.first("payload").alias("payload"))
    whole = payloads.join(kinds.join(kept, "digest", "left").select(*same, "copy", "n", "kept_id"), same)
    every = F.explode(F.sequence(F.col("copy"), F.col("copy") + F.col("n") - 1)).alias("copy")
    out = whole.select("key", "url", "payload", "digest", "kept_id", every).withColumn("record_id", name(F.col("key"), F.col("copy")))
    return out.select(
        F.when(F.col("key") != "null", F.substring("key", F.lit(2), F.length("key"))).alias("page_id"), "url", "payload", "digest", "copy", "record_id",
        F.when(F.col("kept_id") != F.col("record_id"), F.col("kept_id")).alias("refers_to"),
    )


def warc_records(rows: DataFrame) -> DataFrame:
    """(record): three WARC records per capture, as text."""
    target, date = ("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(DATE))
    together = ("WARC-Concurrent-To", F.col("record_id"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    revisit = F.col("refers_to").isNotNull()
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^[^:]*://[^/]*(/[^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1)
    request = F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    body = F.concat(F.lit(HTTP_HEAD), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    about = F.concat(F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id"), F.lit(CRLF)), F.lit("")), F.lit("fetchStatus: 200"), F.lit(CRLF))
    kind = lambda name: ("WARC-Type", F.lit(name) if isinstance(name, str) else name)
    own = lambda name: ("WARC-Record-ID", _urn(F.lit(name), F.col("record_id")))
    profile = F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return rows.select(F.explode(F.array(
        _record([kind("request"), own("request"), together, target, date, ("Content-Type", F.lit("application/http;msgtype=request"))], request),
        _record(
            [kind(F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", F.col("record_id")), target, date, digest, ("WARC-Profile", profile),
             ("WARC-Refers-To", F.col("refers_to")), ("Content-Type", F.lit("application/http;msgtype=response"))], body),
        _record([kind("metadata"), own("metadata"), together, target, date, ("Content-Type", F.lit("application/warc-fields"))], about),
    )).alias("record"))


def records_per_file(pages: DataFrame, html: str = "html", file_bytes: int = FILE_BYTES) -> int:
    """How many records of the pages' mean size make a file of ``file_bytes``."""
    sizes = pages.agg(F.sum(F.octet_length(html)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    mean = HEAD_BYTES + (sizes["bytes"] or 0) / max(3 * sizes["n"], 1)
    return max(3, int(file_bytes / mean))


def write_archives(records: DataFrame, path: str, records_per_file: int) -> None:
    """Gzipped archives: every record ends with two line ends, which is what separates lines here."""
    records.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record, by its Content-Length; a cut-off end raises ValueError."""
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:head].decode("utf-8", "replace").split(CRLF)[1:]
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        start = head + 4
        at = start + int(headers["content-length"])
        if at > len(data):
            raise ValueError(f"record at byte {start} is cut off")
        yield headers, data[start:at]


def _parse(payloads: bool):
    def row(headers: dict[str, str], block: bytes) -> tuple:
        kind = headers.get("warc-type")
        payload = fields = None
        if kind in ("response", "revisit", "request"):
            payload = block.partition(b"\r\n\r\n")[2]
        elif kind == "metadata":
            fields = [(n.strip(), v.strip()) for n, _, v in (l.partition(":") for l in block.decode("utf-8", "replace").splitlines()) if n.strip()]
        stored = kind == "response"
        return (
            kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers.get("warc-date"),
            headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, hashlib.sha1(payload).hexdigest() if stored else None,
            len(payload) if stored else None, payload if payloads and stored else None, fields,
        )

    names = ["kind", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "declared_digest", "payload_digest", "payload_bytes", "payload", "fields"]
    types = [pa.string()] * 8 + [pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for file in files.column("content"):
                data = file.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                rows = []
                for headers, block in parse_records(data):
                    rows.append(row(headers, block))
                    if len(rows) == 2000:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    return run


RECORD_SCHEMA = (
    "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, declared_digest string, "
    "payload_digest string, payload_bytes long, payload binary, fields map<string,string>"
)


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of all archives under ``path``, with gzip or without; payloads only if asked for."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse(payloads), RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit record: capture_id, kind, target_uri, date, payload_digest, payload_bytes, payload,
    refers_to, request, metadata.

    A capture without a request or metadata record has null there; records that name no known response are left out. A revisit's
    payload size comes from the record it refers to, null if that is in no archive.
    """
    answers = records.where(F.col("kind").isin("response", "revisit"))
    part = lambda kind, columns: records.where((F.col("kind") == kind) & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("record_id")).agg(
        F.first(F.struct(*columns)).alias(kind)
    )
    request = part("request", ["record_id", "target_uri", "date"])
    metadata = part("metadata", ["record_id", "fields"])
    original = records.where(F.col("kind") == "response").groupBy(F.col("record_id").alias("_stored")).agg(F.first("payload_bytes").alias("original_bytes"))
    # a record that refers to nothing stands for itself, so that its key is its own and not a null shared by all
    answers = answers.withColumn("_stored", F.coalesce("refers_to", "record_id"))
    whole = answers.join(request, "record_id", "left").join(metadata, "record_id", "left").join(original, "_stored", "left")
    return whole.select(
        F.col("record_id").alias("capture_id"), "kind", "target_uri", "date", F.coalesce("payload_digest", "declared_digest").alias("payload_digest"),
        F.coalesce("payload_bytes", "original_bytes").alias("payload_bytes"), "payload", "refers_to", "request", "metadata",
    )


def round_trip(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages' archives, reads them back and returns one row per capture with its page:
    page_id, payload_bytes, payload_digest, record_type, refers_to (page), capture_id, target_uri, request_id.

    A null html is an empty payload; nulls in url give an empty target; repeated pages keep a row each; a null page_id comes back
    null. An empty table gives archives without records. Line ends in a url are dropped, as they can't stand in a header.
    """
    spark = pages.sparkSession
    store = Stored(spark)
    path = path or f"{store.folder}/archives"
    write_archives(warc_records(captures(pages, page_id, url, html)), path, records_per_file(pages, html))
    records = store.keep(read_records(spark, path))
    whole = assemble(records)
    page = F.col("metadata.fields")["pageId"].cast("long")
    known = whole.select("*", page.alias("page_id"))
    pages_of = known.where("kind = 'response'").select(F.col("capture_id").alias("_stored"), F.col("page_id").alias("refers_page"))
    known = known.withColumn("_stored", F.coalesce("refers_to", "capture_id"))
    return known.join(pages_of, "_stored", "left").select(
        "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
        F.when(F.col("kind") == "revisit", F.col("refers_page")).alias("refers_to"), "capture_id", "target_uri",
        F.col("request.record_id").alias("request_id"),
    )
