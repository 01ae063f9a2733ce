"""WARC archives: one gzip member per record, written and read back.

Writing: payload digests come from the JVM; of equal payloads above a size the one with the
largest page id is a response and the others are revisits. The digests meet without the
payloads, so a payload that a third of all pages share moves no more data than any other.

Reading is sequential: members are decompressed bit by bit, a record's header ends at an empty
line, its block is as long as Content-Length says, and both digests are verified.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import materialize, slices, split_join

ARCHIVE_BYTES = 16 << 20
READ_BYTES = 64 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One gzip member that holds a response, or a revisit of refers_to without the payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id))]
    if url:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    fields += [("WARC-Date", DATE), ("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block))]
    if revisit:
        fields += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def _members(chunks: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """The decompressed pieces of each gzip member; each must be read before the next."""
    source = iter(chunks)
    rest = next(source, b"")

    def pieces() -> Iterator[bytes]:
        nonlocal rest
        z = zlib.decompressobj(31)
        while not z.eof:
            if not rest and not (rest := next(source, b"")):
                raise ValueError("the archive ends within a record")
            out = z.decompress(rest, READ_BYTES * 4)
            rest = z.unused_data if z.eof else z.unconsumed_tail
            if out:
                yield out

    while rest or (rest := next(source, b"")):
        yield pieces()


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def read_records(chunks: Iterable[bytes]) -> Iterator[dict]:
    """Records in order: fields, block, and whether its digests hold. Raises on broken framing."""
    for member in _members(chunks):
        data = bytearray()
        while (at := data.find(b"\r\n\r\n")) < 0:
            piece = next(member, None)
            if piece is None:
                raise ValueError("a record without an end of its header")
            data += piece
        if not data.startswith(b"WARC/"):
            raise ValueError("a record that does not begin with WARC/")
        fields = _fields(bytes(data[:at]))
        for piece in member:
            data += piece
        length = int(fields["content-length"])
        block, end = bytes(data[at + 4 : at + 4 + length]), bytes(data[at + 4 + length :])
        if len(block) != length or end != b"\r\n\r\n":
            raise ValueError("Content-Length does not fit the record")
        yield fields | {"block": block, "block_ok": fields.get("warc-block-digest", _sha1(block)) == _sha1(block)}


def parse_page(record: dict) -> dict:
    """A page row from a record."""
    at = record["block"].find(b"\r\n\r\n")
    http, payload = _fields(record["block"][:at]), record["block"][at + 4 :]
    revisit = record["warc-type"] == "revisit"
    digest = record["warc-payload-digest"]
    number = lambda x: int(m) if x and (m := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number(record["warc-record-id"]), "url": record.get("warc-target-uri"), "record_type": record["warc-type"],
        "payload_bytes": int(http["content-length"]), "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex(),
        "refers_to": number(record.get("warc-refers-to")), "html": None if revisit else payload.decode("utf-8", "replace"),
        "digest_ok": record["block_ok"] and (revisit or (_sha1(payload) == digest and len(payload) == int(http["content-length"]))),
    }


def write_archives(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (archive string, data binary): whole archives of about 16 MB before compression.

    Every row of pages becomes one record. A null html is an empty payload. Among equal payloads
    of at least min_bytes the row with the largest id is the response and the others revisit it;
    rows that share the largest id are all responses. A null id counts as smaller than any other;
    if all are null, all are responses. Other columns are not read. No rows, no archives.
    """
    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("least", F.coalesce("id", F.lit(-(2**63)))).withColumn("digest", F.when(F.octet_length("html") >= min_bytes, F.sha1(F.encode("html", "UTF-8"))))
    keyed = own.where("digest is not null").select("least", "digest")
    owner = keyed.groupBy("digest").agg(F.max("least").alias("owner"), F.count("*").alias("n")).where(f"n > 1 and owner > {-(2**63)}").drop("n")
    to = split_join(keyed, owner, ["digest"]).where("least < owner").distinct()
    joined = own.join(to.hint("shuffle_hash"), ["least", "digest"], "left").select("id", "url", "html", "owner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, size = [], 0
        for b in slices(batches, 64):
            rows = zip(b.column("id").to_pylist(), b.column("url").to_pylist(), b.column("html").cast(pa.binary()).to_pylist(), b.column("owner").to_pylist(), strict=True)
            for id_, url, html, owner in rows:
                data.append(write_record(id_, url, html, owner))
                size += len(html)
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pydict({"data": [b"".join(data)]})
                    data, size = [], 0
        if data:
            yield pa.RecordBatch.from_pydict({"data": [b"".join(data)]})

    return joined.mapInArrow(run, "data binary").select(F.concat(F.sha1("data"), F.lit(".warc.gz")).alias("archive"), "data")


_PAGE = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string, digest_ok boolean"


def _page_batches(chunks: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    """The pages of one archive, some megabytes of blocks at a time."""
    long, text = pa.int64(), pa.string()
    kinds = pa.schema([("page_id", long), ("url", text), ("record_type", text), ("payload_bytes", long), ("payload_digest", text), ("refers_to", long), ("html", text), ("digest_ok", pa.bool_())])
    rows, size = [], 0
    for record in read_records(chunks):
        rows.append(parse_page(record))
        size += len(record["block"])
        if size >= ARCHIVE_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of archives(data binary): see parse_page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data"):
                view = memoryview(data.as_buffer())
                yield from _page_batches(bytes(view[i : i + READ_BYTES]) for i in range(0, len(view), READ_BYTES))

    return archives.select("data").mapInArrow(run, _PAGE)


def read_files(paths: DataFrame, open_file: Callable[[str], BinaryIO]) -> DataFrame:
    """One row per record of the archive files paths(path string), of any size: a file is read from its
    begin to its end, a few kilobytes at a time. open_file opens a path where the workers run; it
    decides which store that is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                with open_file(path) as f:
                    yield from _page_batches(iter(lambda f=f: f.read(READ_BYTES), b""))

    return paths.select("path").mapInArrow(run, _PAGE)


def save_archives(archives: DataFrame, directory: str) -> None:
    """Writes each archive as a file of its own; directory is one that all executors mount."""

    def save(rows: Iterator) -> None:
        import os

        os.makedirs(directory, exist_ok=True)
        for r in rows:
            with open(f"{directory}/.{r.archive}.part", "wb") as f:
                f.write(r.data)
            os.replace(f"{directory}/.{r.archive}.part", f"{directory}/{r.archive}")

    archives.foreachPartition(save)


def load_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archive files as rows (archive, data)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.col("content").alias("data"))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Writes every page to archives, reads them back and describes the records."""
    archives = materialize(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), "warc", "none")
    found = read_archives(archives)
    bad = F.raise_error(F.concat(F.lit("digest of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    return found.select("page_id", "payload_bytes", F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(bad).alias("payload_digest"), "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN owner END AS refers_to
FROM o
"""
