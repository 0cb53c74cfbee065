"""WARC archives with a Zstandard dictionary in front, written and read by executors.

Method: a dictionary is built from a bounded sample of the records to archive. Each archive begins with a skippable
frame that holds the dictionary; each record follows as a frame of its own, compressed with it. Records with equal
payloads refer to one response by revisit records.

Scale: payloads are hashed where they lie, and only digests are aggregated; rows are looked up in the digests that occur
more than once. Tasks write archives of bounded size to the shared folder, under names that no other attempt uses, and
return them in a manifest; archives of attempts that failed are in no manifest. Reading is streamed.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, join_small, make_dir, opened, shared_dir

MAGIC = 0x184D2A5D
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Writer:
    """archive_bytes: size at which the next archive is begun. dictionary_bytes, sample_records, sample_bytes: bounds of the
    dictionary and what it is built from. level: of compression. date: of records, where no fetch time is known.
    """

    archive_bytes: int = 64_000_000
    dictionary_bytes: int = 65_536
    sample_records: int = 400
    sample_bytes: int = 4_000_000
    level: int = 3
    date: str = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page: object) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def record(page, url: str | None, payload: bytes, refers_to=None, date: str = Writer.date, revisit: bool = False) -> bytes:
    """A WARC/1.1 record. A revisit has the HTTP header alone, with the length of the payload that it stands for."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}"]
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; ValueError if it is damaged."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    n = int(fields.get("Content-Length", -1))
    if first != "WARC/1.1" or not gap or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"damaged record: {raw[:80]!r}")
    return fields, rest[:n]


def build_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples' last bytes themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b"WARC/1.1\r\n"


def compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)


def header(dictionary: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(dictionary)) + dictionary


def _exactly(stream, n: int) -> bytes:
    parts, left = [], n
    while left:
        if not (part := stream.read(left)):
            raise ValueError("the archive ends inside its dictionary frame")
        parts.append(part)
        left -= len(part)
    return b"".join(parts)


def records(stream, chunk: int = 1 << 15) -> Iterator[bytes]:
    """The records of an archive, read from its own dictionary on; one record is held at a time."""
    lead = _exactly(stream, 8)
    magic, size = struct.unpack("<II", lead)
    if magic != MAGIC:
        raise ValueError("no dictionary frame at the begin of the archive")
    dictionary = _exactly(stream, size)
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    left = b""
    while left := left or stream.read(chunk):
        frame, parts = context.decompressobj(), []
        while True:
            parts.append(frame.decompress(left))
            if frame.eof:
                left = frame.unused_data
                break
            left = stream.read(chunk)
            if not left:
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def _with_references(pages: DataFrame, row: str, url: str, html: str) -> DataFrame:
    """(_page, _url, _html, _to): _to is the page that has the response, null for responses."""
    rows = pages.select(F.col(row).alias("_page"), F.col(url).alias("_url"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    # Equality goes by SHA-256 and length, as SHA-1, which the records carry, has known collisions.
    rows = rows.withColumn("_sha", F.unhex(F.sha2(F.col("_html").cast("binary"), 256))).withColumn("_size", F.octet_length("_html"))
    copies = cut(rows.groupBy("_sha", "_size").agg(F.max("_page").alias("_last"), F.count("*").alias("_n")).filter("_n > 1 and _last is not null").select("_sha", "_size", "_last"))
    rows = join_small(rows, copies, ["_sha", "_size"])
    return rows.select("_page", "_url", "_html", F.when(F.coalesce(F.col("_last") != F.col("_page"), F.col("_last").isNotNull()), F.col("_last")).alias("_to"))


def write(pages: DataFrame, folder: str | None = None, w: Writer = Writer(), row: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for each row of pages; returns the manifest (archive, records, bytes), kept in the checkpoint folder.

    Of rows with equal payloads the one with the largest id has the response, others revisit it; rows that share that id
    all have it, and so have rows of payloads that come with null ids only. A null payload is empty. Other columns of
    pages aren't read.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = _with_references(pages, row, url, html)
    # First hashes of ids and urls alone are ranked; then the few pages up to the last of them are fetched.
    hashed = pages.select(F.xxhash64(row, url).alias("_h"), F.col(row).alias("_page"), F.col(url).alias("_url"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    marks = [r[0] for r in hashed.select("_h").orderBy("_h").limit(w.sample_records).collect()]
    some = hashed.filter(F.col("_h") <= (marks[-1] if marks else 0)).limit(w.sample_records)
    samples, size = [], 0
    for r in some.toLocalIterator():
        payload = r["_html"].encode("utf-8", "surrogatepass")
        samples.append(record(r["_page"], r["_url"], payload, date=w.date)[: w.sample_bytes - size])
        size += len(samples[-1])
        if size >= w.sample_bytes:
            break
    dictionary = rows.sparkSession.sparkContext.broadcast(build_dictionary(samples, w.dictionary_bytes))
    local = folder if not folder.startswith("file:") and ":" in folder.split("/")[0] else re.sub(r"^file:/*", "/", folder)
    make_dir(rows.sparkSession, folder)
    schema = StructType.fromDDL("archive string, records long, bytes long")

    def run(batches):
        pack, made = compressor(dictionary.value, w.level), []

        def pieces():
            for b in batches:
                for page, at, text, to in zip(*(c.to_pylist() for c in b.columns)):
                    raw = record(page, at, text.encode("utf-8", "surrogatepass"), to, w.date, to is not None)
                    yield pack.compress(raw)

        todo = pieces()
        piece = next(todo, None)
        while piece is not None:
            path = f"{local}/{uuid.uuid4().hex}.warc.zst"
            with opened(path, "wb") as f:
                f.write(lead := header(dictionary.value))
                n, size = 0, len(lead)
                while piece is not None and (n == 0 or size + len(piece) <= w.archive_bytes):
                    f.write(piece)
                    n, size, piece = n + 1, size + len(piece), next(todo, None)
            made.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made) if made else ((), (), ()), (pa.string(), pa.int64(), pa.int64()))], names=schema.names)

    return cut(rows.mapInArrow(run, schema)).withMetadata("archive", {"page_type": pages.schema[row].dataType.simpleString()})


def read(manifest: DataFrame, page_type: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of every record in the archives.

    Ids have page_type; None: the type that they were written with, as the manifest's metadata has it, else text. payload is null for revisits. A record whose payload isn't what its digest says fails the read.
    """
    schema = StructType.fromDDL("_page string, payload_bytes long, payload_digest string, record_type string, _to string, url string, payload binary")
    page_type = page_type or manifest.schema["archive"].metadata.get("page_type", "string")
    page = lambda x: x.removeprefix("<urn:x-page:").removesuffix(">") or None

    def run(batches):
        def rows(path):
            with opened(path, "rb") as f:
                for raw in records(f):
                    fields, block = parse(raw)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    said, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and (len(payload) != n or digest(payload) != said):
                        raise ValueError(f"{path}: the payload of {fields['WARC-Record-ID']} isn't what its digest says")
                    yield page(fields["WARC-Record-ID"]), n, said, kind, page(fields.get("WARC-Refers-To", "")), fields["WARC-Target-URI"], payload if kind == "response" else None

        for b in batches:
            for path in b.column(0).to_pylist():
                held, size = [], 0
                for r in rows(path):
                    held.append(r)
                    size += len(r[6] or b"")
                    if len(held) == 1000 or size > 8_000_000:
                        yield _batch(held, schema)
                        held, size = [], 0
                if held:
                    yield _batch(held, schema)

    n = manifest.select("archive")
    found = n.repartition(max(1, manifest.rdd.getNumPartitions())).mapInArrow(run, schema)
    return found.select(
        F.col("_page").cast(page_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("_to").cast(page_type).alias("refers_to"), "url", "payload"
    )


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), kinds)], schema=kinds)
