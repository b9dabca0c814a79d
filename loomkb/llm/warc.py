"""WARC archives: one gzip member per record, read back sequentially.

Writing: payloads are hashed in the scan; of equal payloads of at least
``REVISIT_BYTES`` bytes the one with the largest page id becomes the response
and the others revisits of it. Records are framed and compressed in tasks and
written by Spark's own file writer, so any store that Spark reaches works and a
lost task is simply written again.

Reading: each archive is decompressed incrementally, member by member; a record
is framed by its Content-Length and checked against its digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkb.session import table
from loomkb.storage import materialize, scratch_path

REVISIT_BYTES = 1000
#: Capture time written to every record: archives of equal pages are equal.
CAPTURED = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive file is closed at so many records or bytes; a longer record has a file of its own.
RECORDS_PER_FILE, FILE_BYTES = 2000, 32 << 20
#: Spark ends each row with a separator; an empty gzip member is one that every reader skips.
EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
CHUNK = 1 << 16


class WarcError(ValueError):
    """A record that is cut off, badly framed or does not match its digest."""


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def digest_label(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def frame(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, sha1_hex: str) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header and drops the payload."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    target = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, sha1_hex)),
        ("WARC-Date", CAPTURED),
        *([("WARC-Target-URI", target)] if target else []),
        *([("WARC-Page-ID", str(page_id))] if page_id is not None else []),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, sha1_hex)), ("WARC-Refers-To-Page-ID", str(refers_to))] if revisit else []),
        ("WARC-Payload-Digest", digest_label(sha1_hex)),
        ("WARC-Block-Digest", digest_label(hashlib.sha1(block).hexdigest())),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8")) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def members(archive: bytes) -> Iterator[bytes]:
    """The gzip members of an archive one after another, inflated in chunks; empty ones are skipped."""
    view, at = memoryview(archive), 0
    while at < len(view):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            chunk = view[at : at + CHUNK]
            if not chunk:
                raise WarcError("archive ends inside a gzip member")
            try:
                parts.append(inflate.decompress(chunk))
            except zlib.error as e:
                raise WarcError(f"bad gzip data at byte {at}: {e}") from e
            at += len(chunk) - len(inflate.unused_data)
        data = b"".join(parts)
        if data:
            yield data


def read_record(member: bytes) -> dict:
    """Header fields, block and payload of one record; raises WarcError unless everything fits."""
    head, split, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not split or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not frame the block")
    if digest_label(hashlib.sha1(block).hexdigest()) != fields["warc-block-digest"]:
        raise WarcError("block digest differs")
    http, split, payload = block.partition(b"\r\n\r\n")
    http_fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode("latin-1").split("\r\n")[1:])}
    if fields["warc-type"] == "response":
        if digest_label(hashlib.sha1(payload).hexdigest()) != fields["warc-payload-digest"]:
            raise WarcError("payload digest differs")
        if len(payload) != int(http_fields["content-length"]):
            raise WarcError("payload length differs")
    fields["payload-bytes"] = http_fields["content-length"]
    return {"fields": fields, "payload": payload}


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row of ``pages`` below ``path``.

    Null html is an empty payload, null urls and ids leave their header out. A
    payload of any length is one record; files are bounded in records and bytes.
    Repeated rows of the id that stays are all responses. Equal digests count
    as equal payloads only with equal lengths.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    size = F.length("payload")
    hashed = rows.where(size >= REVISIT_BYTES).select("sha1", size.alias("size"), "page_id")
    repeated = materialize(
        hashed.groupBy("sha1", "size").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "repeated",
    )
    found = rows.alias("r").join(
        repeated.alias("d"), (F.col("r.sha1") == F.col("d.sha1")) & (F.length("r.payload") == F.col("d.size")), "left"
    )
    refers = F.when(F.col("d.response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("d.response_id")), F.col("d.response_id"))
    # as text, ids beside nulls keep all their digits in pandas
    page_id, refers_to = F.col("page_id").cast("string").alias("page_id"), refers.cast("string").alias("refers_to")
    records = found.select(page_id, "url", "payload", refers_to, F.col("r.sha1").alias("sha1"))

    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def whole(x: str | None) -> int | None:
            return None if x is None else int(x)

        held, size = [], 0
        for b in batches:
            for i, u, p, r, s in zip(b["page_id"], b["url"], b["payload"], b["refers_to"], b["sha1"]):
                held.append(frame(whole(i), u, p, whole(r), s))
                size += len(held[-1])
                if len(held) >= RECORDS_PER_FILE or size >= FILE_BYTES:
                    yield pd.DataFrame({"archive": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"archive": [b"".join(held)]})

    # the text writer stores the bytes of a string as they are
    out = records.mapInPandas(framed, "archive binary").select(F.col("archive").cast("string").alias("value"))
    writer = out.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
    writer.option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``.

    Columns: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest (hex; for a revisit those of the payload it refers to) and
    payload (null for a revisit). A damaged archive fails the read.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive in batch["content"]:
                rows = []
                for member in members(archive):
                    record = read_record(member)
                    f = record["fields"]
                    revisit = f["warc-type"] == "revisit"
                    rows.append(
                        (
                            f.get("warc-page-id"),
                            f.get("warc-target-uri"),
                            f["warc-type"],
                            f.get("warc-refers-to-page-id"),
                            int(f["payload-bytes"]),
                            base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex(),
                            None if revisit else record["payload"],
                        )
                    )
                    if len(rows) == 500:
                        yield table_of(rows)
                        rows = []
                if rows:
                    yield table_of(rows)

    def table_of(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    spec = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    out = files.mapInPandas(parsed, spec)
    return out.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def op3_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
k AS (SELECT *, CASE WHEN n >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY d, n) END AS r FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN r <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN r <> page_id THEN r END AS refers_to FROM k
"""
