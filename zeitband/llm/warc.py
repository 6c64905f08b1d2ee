"""WARC archives, index first.

Each task writes its records to archives of its own in the shared folder, one gzip member per record, and returns one
index row per record: archive, offset, length, URL and digest. The index is a table that Spark commits; an archive
that a lost or repeated task left behind is named by no index row. Readers take the index rows they select, sort
them by archive and offset, read runs of neighbouring records in one go and check each payload against its digest.

Of records with equal payloads of at least ``least_bytes``, the one with the smallest page_id is a response and the
others revisit it. Defined cases: a null payload is empty; a null URL is an empty target; line breaks in a URL are
percent-encoded; a record with a null page_id is a response that none revisits; repeated rows with the smallest
page_id are all responses; payloads of any length are written whole, and one longer than a read takes a read of its own;
an empty table gives an empty index; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zeitband.shared import new_folder

from .common import blocks, materialize

INDEX = "page_id string, archive string, offset long, length long, url string, digest string"
#: An archive is closed after so many bytes; one read takes at most so many, over gaps of at most so many.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
#: Records of one archive are read in parallel by stretches of so many bytes.
STRETCH_BYTES = 32 << 20
#: Pages of one payload are looked at in so many slices.
SLICES = 256


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> tuple[bytes, str]:
    """The bytes of one record, and the digest of its payload."""
    digest = base32_sha1(payload)
    name = lambda x: f"<urn:page:{x or ''}:{digest}>"
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n", digest


def page_of(name: str) -> str | None:
    """The page_id in a record's name; it may hold colons, the digest behind it holds none."""
    return name.removeprefix("<urn:page:").rpartition(":")[0] or None


def parse(raw: bytes) -> tuple[str | None, int, str, str, str | None]:
    """page_id, payload bytes, payload digest, record type and the page that it refers to."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    page = page_of(fields["WARC-Record-ID"])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
        return page, size, stated, "revisit", page_of(fields["WARC-Refers-To"])
    if (digest := base32_sha1(payload)) != stated:
        raise ValueError(f"page {page}: payload digest {digest}, record says {stated}")
    return page, len(payload), digest, "response", None


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to. Only digests and ids are grouped; payloads move once, by page."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    keyed = rows.withColumn("key", F.sha2(F.col("payload").cast("binary"), 256))
    thin = keyed.filter(F.octet_length("payload") >= least_bytes).select("page_id", "key")
    # Payloads in slices of their pages: a payload of very many pages is not told to all of them by one task.
    thin = thin.withColumn("slice", F.pmod(F.xxhash64("page_id"), F.lit(SLICES)).cast("int"))
    slices = thin.groupBy("key", "slice").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("m"))
    first = slices.groupBy("key").agg(F.min("least").alias("refers_to"), F.sum("m").alias("n")).filter("n > 1").drop("n")
    later = thin.join(slices.select("key", "slice").join(first, "key"), ["key", "slice"]).filter("page_id <> refers_to").drop("slice").distinct()
    return keyed.join(later, ["page_id", "key"], "left").drop("key")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) under ``path``, and return the index table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = fs.FileSystem.from_uri(path)
        where.create_dir(folder, recursive=True)
        out, at, archive = None, 0, ""
        try:
            for b in blocks(batches, "payload"):
                index = []
                for page, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        archive, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = where.open_output_stream(f"{folder}/{archive}", compression=None)
                    raw, digest = record(page, url, payload.encode(), refers_to)
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    member = packer.compress(raw) + packer.flush()
                    out.write(member)
                    index.append((page, archive, at, len(member), url, digest))
                    at += len(member)
                columns = list(zip(*index, strict=True)) or [()] * 6
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "archive", "offset", "length", "url", "digest"])
        finally:
            if out is not None:
                out.close()

    rows = with_revisits(pages, least_bytes).sortWithinPartitions("page_id")
    text = rows.select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"))
    return materialize(text.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records that ``index`` selects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = fs.FileSystem.from_uri(path)
        name, file = None, None
        for b in batches:
            wanted = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            found, i = [], 0
            while i < len(wanted):
                archive, start, length = wanted[i]
                end, j = start + length, i + 1
                while j < len(wanted) and wanted[j][0] == archive and 0 <= wanted[j][1] - end <= GAP_BYTES and wanted[j][1] + wanted[j][2] - start <= READ_BYTES:
                    end, j = wanted[j][1] + wanted[j][2], j + 1
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, where.open_input_file(f"{folder}/{archive}")
                raw = file.read_at(end - start, start)
                found += [parse(zlib.decompress(raw[o - start : o - start + n], 31)) for _, o, n in wanted[i:j]]
                i = j
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if file is not None:
            file.close()

    stretch = (F.col("offset") / F.lit(STRETCH_BYTES)).cast("long")
    # As many tasks as there are bytes to read, not as the index has rows.
    tasks = math.ceil((index.agg(F.sum("length")).first()[0] or 0) / STRETCH_BYTES) * 2 + 1
    ranges = index.repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "offset").select("archive", "offset", "length")
    return ranges.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read every record back."""
    path = new_folder(pages.sparkSession, "warc")
    index = write_archives(pages, path, least_bytes)
    kind = pages.schema["page_id"].dataType
    return read_records(index, path).withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
