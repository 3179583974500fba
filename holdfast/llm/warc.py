"""WARC archives: written from pages, read back, and joined into one nested row per capture.

A capture is three records: a request, a response or revisit, and a metadata record. Request and
metadata name the response in WARC-Concurrent-To; ``captures`` joins them on these identifiers.
A page whose payload equals that of another page becomes a revisit that refers to the response.

Archives are gzip files that Spark's text source writes and reads with the record boundary as
line separator, so records of any size stream and nothing but Spark touches the store. A payload that
holds the boundary itself is split by the reader and put together again by its Content-Length, and
parts that hold several records are taken apart by it: a gzip file is never split over tasks, so the parts follow each other in one stream. Text
columns carry the bytes as they are; payloads need not be valid UTF-8.

Null html is an empty payload, a null url an empty target, a null page_id an empty field, read
back as null. Rows that repeat page_id, url and html are captures of their own: those of the
largest page_id are all written as responses. An empty table gives empty archives. Further
columns are ignored. A record without partner gives a capture with nulls for what is missing.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm.common import own_columns, stage

# Fixed values of the archive format.
VERSION = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

CAPTURED_AT = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 30_000


def base32(hex_digits: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five hex digits are four base32 digits."""

    def four(i: Column) -> Column:
        part = F.conv(F.substring(hex_digits, 1 + 5 * i, F.lit(5)), 16, 10).cast("int")
        digits = [F.shiftright(part, k).bitwiseAND(F.lit(31)) + 1 for k in (15, 10, 5, 0)]
        return F.concat(*[F.substring(F.lit(BASE32), d, F.lit(1)) for d in digits])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(GAP))
    return F.concat(F.lit(VERSION), *lines, length, block)


def plan_captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages plus payload, digest, record_type, refers_key: which page is a response and which a revisit."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    row = F.to_json(F.struct(F.col("page_id").cast("string").alias("p"), "url"), {"ignoreNullFields": "false"})
    prepared = own_columns(pages, "page_id", "url", "html").select(
        "page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
    ).withColumn("row_key", F.sha1(F.concat(row, F.col("digest"))))
    light = stage(prepared.select("row_key", "page_id", "digest", "payload_bytes"), "payload_digests")
    keepers = stage(
        light.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.max(F.struct("page_id", "row_key")).alias("keeper")),
        "keepers",
    )
    revisit = F.col("keeper").isNotNull() & ~F.col("keeper.page_id").eqNullSafe(F.col("page_id"))
    decided = light.join(keepers, "digest", "left").select(
        "row_key",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keeper.row_key")).alias("refers_key"),
    )
    decided = stage(decided.distinct(), "decisions")
    copy = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))
    return prepared.join(decided, "row_key").withColumn("copy", copy)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, captured_at: str = CAPTURED_AT) -> None:
    """Three records per page, as gzip files below ``path``."""
    c = plan_captures(pages, min_bytes)
    url = F.coalesce(F.col("url"), F.lit(""))
    number = F.col("copy").cast("string")
    own = _uuid(F.lit("response"), F.col("row_key"), number)
    first = [("WARC-Date", F.lit(captured_at)), ("WARC-Target-URI", url)]
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(GAP),
    )
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest"))))
    answer = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record(
        [("WARC-Type", F.lit("response")), ("WARC-Record-ID", own), *first, digest, answer],
        F.concat(http, F.col("payload")),
    )
    revisit = _record(
        [
            ("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", own), *first, digest,
            ("WARC-Profile", F.lit(REVISIT_PROFILE)),
            ("WARC-Refers-To", _uuid(F.lit("response"), F.col("refers_key"), F.lit("1"))), answer,
        ],
        http,
    )
    request = _record(
        [
            ("WARC-Type", F.lit("request")),
            ("WARC-Record-ID", _uuid(F.lit("request"), F.col("row_key"), number)), *first,
            ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1" + GAP)),
    )
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", _uuid(F.lit("metadata"), F.col("row_key"), number)), *first,
            ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")),
    )
    main = F.when(F.col("record_type") == "revisit", revisit).otherwise(response)
    records = c.select(F.explode(F.array(request, main, metadata)).alias("value"))
    records.write.option("lineSep", GAP).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(path)


_RECORD_FIELDS = (
    "record_id string, kind string, concurrent_to array<string>, target_uri string, date string, "
    "payload_digest string, refers_to string, fields string, payload_bytes bigint, payload binary"
)
_RECORD_SCHEMA = pa.schema(
    [
        ("record_id", pa.string()), ("kind", pa.string()), ("concurrent_to", pa.list_(pa.string())),
        ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()),
        ("refers_to", pa.string()), ("fields", pa.string()), ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _headers(lines: bytes) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for line in lines.split(b"\r\n"):
        name, _, value = line.partition(b":")
        out.setdefault(name.strip().lower().decode("utf-8", "replace"), []).append(
            value.strip().decode("utf-8", "replace")
        )
    return out


def _parse(raw: bytes, with_payload: bool) -> tuple[dict, bytes] | None:
    """The first record and what follows it, or None while its block is shorter than its Content-Length."""
    head, gap, block = raw.partition(GAP.encode())
    fields = _headers(head)
    length = int(fields.get("content-length", ["0"])[0])
    if not gap or len(block) < length:
        return None
    block, rest = block[:length], block[length:]
    one = lambda name: fields.get(name, [None])[0]
    kind = one("warc-type")
    payload, size, digest, text = None, None, (one("warc-payload-digest") or "").removeprefix("sha1:") or None, None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(GAP.encode())
        size = int(_headers(http).get("content-length", ["0"])[0])
        if kind == "response":
            size = len(payload)
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            payload = None
    elif kind == "metadata":
        text = block.decode("utf-8", "replace")
    record = {
        "record_id": one("warc-record-id"), "kind": kind, "concurrent_to": fields.get("warc-concurrent-to", []),
        "target_uri": one("warc-target-uri"), "date": one("warc-date"), "payload_digest": digest,
        "refers_to": one("warc-refers-to"), "fields": text, "payload_bytes": size,
        "payload": payload if with_payload else None,
    }
    return record, rest


def _parser(with_payload: bool):
    boundary = (GAP + VERSION).encode()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_file = None, None
        for batch in batches:
            out = []
            for part, file in zip(batch.column(0), batch.column(1)):
                part, file = part.as_py(), file.as_py()
                if file != held_file:
                    if held is not None:
                        raise ValueError(f"archive ends within a record: {held_file}")
                    part = part.removeprefix(VERSION.encode())
                    held_file = file
                held = part if held is None else held + boundary + part
                # The reader may miss a boundary after bytes that resemble it; the lengths decide.
                while held is not None and (parsed := _parse(held, with_payload)):
                    record, rest = parsed
                    out.append(record)
                    held = rest.removeprefix(boundary) if rest.startswith(boundary) else None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_RECORD_SCHEMA)
        if held is not None:
            raise ValueError(f"archive ends within a record: {held_file}")

    return parse


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the gzip archives below ``path``; payload null unless asked for."""
    parts = spark.read.option("lineSep", GAP + VERSION).text(path)
    raw = parts.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    return raw.mapInArrow(_parser(with_payload), _RECORD_FIELDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (or revisit), its requests and its metadata records.

    A record belongs to a capture if either names the other in WARC-Concurrent-To.
    """
    is_main = F.coalesce(F.col("kind").isin("response", "revisit"), F.lit(False))
    names = F.array_union(F.array("record_id"), F.coalesce("concurrent_to", F.array().cast("array<string>")))
    main = records.filter(is_main)
    links = main.select(F.col("record_id").alias("capture_id"), F.explode(names).alias("link"))
    others = records.filter(~is_main).select(
        "kind", F.struct("record_id", "target_uri", "date", "fields").alias("record"), F.explode(names).alias("link")
    )
    joined = others.join(links.distinct(), "link", "left")
    # A record that names no response is a capture of its own, unless another of its links has one.
    best = joined.groupBy("record.record_id", "kind").agg(
        F.first("record").alias("record"), F.collect_set("capture_id").alias("found")
    )
    own = F.when(F.size("found") > 0, F.col("found")).otherwise(
        F.array(F.concat(F.lit("without response "), F.col("record.record_id")))
    )
    placed = best.select("kind", "record", F.explode(own).alias("capture_id"))
    sides = placed.groupBy("capture_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "request", F.col("record")))).alias("requests"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "metadata", F.col("record")))).alias("metadata"),
    )
    answer = main.select(
        F.col("record_id").alias("capture_id"),
        F.struct(
            "record_id", "kind", "target_uri", "date", "payload_digest", "payload_bytes", "refers_to", "payload"
        ).alias("response"),
    )
    return answer.join(sides, "capture_id", "full")


def page_id_of(metadata: Column) -> Column:
    """The page-id field of the first metadata record."""
    fields = F.element_at(metadata, 1)["fields"]
    return F.regexp_extract(fields, r"(?m)^page-id: (-?\d+)\r?$", 1).try_cast("bigint")
