"""WARC archives: pages to whole-file gzip archives, a normaliser to one gzip member a record, and a reader.

The normaliser takes archives whose whole file is one gzip stream (no record can be reached alone), inflates each
once, writes every record as its own member and a sidecar index (one JSON line a record: offset, length, type, id).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import salted_lookup, shared_path, written
from tabprobe.llm.files import open_read, open_write

#: The profile of revisits by payload digest, and the line ends of the format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
READ_BYTES = 1 << 20


# ---- records ----------------------------------------------------------------------------------------------------

def _clean(value: str) -> str:
    """A header value without control characters, which are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: dict, date: str) -> bytes:
    """A response or revisit record of ``page_id, url, html, record_type, refers_to, digest, payload_bytes``."""
    payload = row["html"] or b""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if row["record_type"] == "response" else b"")
    sha1 = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head = [b"WARC/1.1", f"WARC-Type: {row['record_type']}".encode(), f"WARC-Record-ID: <urn:page:{row['page_id']}>".encode(),
            f"WARC-Date: {date}".encode()]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_clean(row['url'])}".encode())
    head += [b"Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}".encode(),
             f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}".encode()]
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {REVISIT}".encode(), f"WARC-Refers-To: <urn:page:{row['refers_to']}>".encode()]
    head.append(f"Content-Length: {len(block)}".encode())
    return CRLF.join(head) + CRLF + CRLF + block + CRLF + CRLF


class RecordStream:
    """Records of an inflated byte stream, one at a time: (headers, raw record bytes). Holds one record and a chunk."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, bytearray()

    def _fill(self, n: int) -> bool:
        while len(self.held) < n:
            chunk = next(self.chunks, None)
            if chunk is None:
                return False
            self.held += chunk
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes, int]]:
        while True:
            seen = 0
            while (end := self.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
                seen = len(self.held)
                if not self._fill(seen + 1):
                    if bytes(self.held).strip():
                        raise ValueError("the archive ends inside a record")
                    return
            lines = bytes(self.held[:end]).decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a record")
            headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
            total = end + 4 + int(headers["content-length"]) + 4
            if not self._fill(total):
                raise ValueError("the archive ends inside a record")
            yield headers, bytes(self.held[:total]), end + 4
            del self.held[:total]


def inflated(file, size: int = READ_BYTES) -> Iterator[bytes]:
    """The bytes of a gzip file with one or more members, inflated once in bounded pieces."""
    z, pending = zlib.decompressobj(31), b""
    while data := pending or file.read(size):
        pending = b""
        out = z.decompress(data, 4 * size)
        if z.eof:
            pending, z = z.unused_data, zlib.decompressobj(31)
        else:
            pending = z.unconsumed_tail
        if out:
            yield out


# ---- Spark jobs -------------------------------------------------------------------------------------------------

def record_types(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, record_type, refers_to``.

    Of equal payloads of at least ``min_bytes`` bytes the one with the largest ``page_id`` is the response and others
    revisit it. Rows that share that largest id are responses all; a null id is the smallest.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1("html"))
    large = rows.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_bytes", "payload_digest",
                                                                   F.sha2("html", 256).alias("sha256"))
    groups = large.groupBy("payload_digest", "payload_bytes", "sha256").agg(
        F.count(F.lit(1)).alias("n"), F.max("page_id").alias("best")).where("n > 1")
    # slim rows only are joined by payload: pages in a group of equals
    copies = salted_lookup(large, groups, ["payload_digest", "payload_bytes", "sha256"], "inner").where(
        "NOT page_id <=> best").groupBy("page_id", "payload_digest", "payload_bytes").agg(F.max("best").alias("refers_to"))
    copies = copies.select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "refers_to")
    found = rows.join(copies, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d"))
                      & (F.col("payload_bytes") == F.col("b")), "left")
    kind = F.when(F.col("b").isNull(), "response").otherwise("revisit")
    return found.select("page_id", "url", "html", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


MANIFEST = "path string, records long, stored long"


def write_archives(typed: DataFrame, folder: str | None = None, file_bytes: int = 64 << 20, level: int = 1,
                   date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes each partition's records to archives that are one gzip stream each; returns the manifest of committed files."""
    folder = folder or shared_path(typed.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, z, path = TaskContext.get().partitionId(), 0, None, None, ""
        n, size, stored = 0, 0, 0

        def close() -> pa.RecordBatch:
            tail = z.flush()
            out.write(tail)
            out.close()
            return pa.RecordBatch.from_pylist([{"path": path, "records": n, "stored": stored + len(tail)}])

        for batch in batches:
            for i in range(batch.num_rows):
                raw = record(batch.slice(i, 1).to_pylist()[0], date)
                if out is None:
                    path = f"{folder}/whole/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.warc.gz"
                    out, z, n, size, stored = open_write(path), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0, 0
                packed = z.compress(raw)
                out.write(packed)
                n, size, stored = n + 1, size + len(raw), stored + len(packed)
                if size >= file_bytes:
                    yield close()
                    out, seq = None, seq + 1
        if out is not None:
            yield close()

    return written(typed.mapInArrow(write, MANIFEST), "warc-manifest")


def normalise_archives(manifest: DataFrame, level: int = 6) -> DataFrame:
    """Rewrites whole-file gzip archives with one member a record, each with a sidecar index; ``path, index, records``.

    An archive is inflated once, in pieces; memory holds one record. Archives are dealt out to tasks by path.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("path").to_pylist():
                stem, name = source.rsplit("/", 1)
                target = f"{stem.removesuffix('/whole')}/members/{name.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
                at = n = 0
                with open_read(source) as src, open_write(target) as out, open_write(f"{target}.index") as index:
                    for headers, raw, _ in RecordStream(inflated(src)):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        index.write((json.dumps({"offset": at, "length": len(member), "type": headers["warc-type"],
                                                 "id": headers["warc-record-id"], "uri": headers.get("warc-target-uri"),
                                                 "digest": headers.get("warc-payload-digest")}) + "\n").encode())
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_pylist([{"path": target, "index": f"{target}.index", "records": n}])

    files = manifest.repartition(max(1, manifest.count()), "path")  # a given number is not merged for being few bytes
    return written(files.mapInArrow(rewrite, "path string, index string, records long"), "warc-members")


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_member(path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the record in the gzip member at ``offset``, without the rest of the archive."""
    with open_read(path) as f:
        f.seek(offset)
        raw = zlib.decompress(f.read(length), 31)
    headers, whole, body = next(iter(RecordStream(iter([raw]))))
    return headers, whole[body:-4].partition(b"\r\n\r\n")[2]


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long"


def read_archives(members: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """A row a record, read through the sidecar index; payload digests of responses are checked.

    The size of a revisited payload is what its HTTP headers say.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                rows = []
                with open_read(m["index"]) as index, open_read(m["path"]) as f:
                    for line in index.read().splitlines():
                        entry = json.loads(line)
                        f.seek(entry["offset"])
                        raw = zlib.decompress(f.read(entry["length"]), 31)
                        headers, whole, body = next(iter(RecordStream(iter([raw]))))
                        http, _, payload = whole[body:-4].partition(b"\r\n\r\n")
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
                        if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
                        rows.append({"page_id": _page(headers["warc-record-id"]), "payload_bytes": size, "payload_digest": digest,
                                     "record_type": headers["warc-type"], "refers_to": _page(headers.get("warc-refers-to")),
                                     "url": headers.get("warc-target-uri"), "archive": m["path"], "offset": entry["offset"]})
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return members.repartition(max(1, members.count()), "path").mapInArrow(read, READ)


SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                    ("refers_to", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("offset", pa.int64())])


def warc_round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Pages (``page_id, url, html``) to archives, normalised, and read back: a row a page.

    Null html is an empty payload, a null url has no target URI, null and repeated ids keep a row each; other columns
    are ignored; an empty table gives an empty result.
    """
    return read_archives(normalise_archives(write_archives(record_types(pages, min_bytes))))
