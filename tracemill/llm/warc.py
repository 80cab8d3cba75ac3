"""WARC archives with a two-level capture index.

Writing: each record is a gzip member of its own in one archive file per task; of records with equal payloads all but one
are revisits without a body.  Indexing: captures are sorted by reversed-host URL key and id, range-partitioned into
shards; a shard file holds the sorted lines in compressed blocks and, behind them, a sparse directory with the first line
of each block.  Looking up: the shard is found by binary search among the shards' first keys, the block by binary search
in the shard's directory, and then the block and the record are read by range.

Archives and shards go to the shared storage through pyarrow's file systems.  A task that runs again writes files of new
names; only those that the committed capture table or shard list names are ever read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections import OrderedDict

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.storage import Workspace

#: Lines in one compressed block of the index.
BLOCK_LINES = 256
#: Shards at most: their first keys are what a lookup is sent.
MAX_SHARDS = 4096
#: Archive files that a lookup task keeps open.
OPEN_FILES = 32
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

#: Where a shard's directory lies, in its last bytes: offset and length.
_FOOTER = "<QQ"


def surt(url: str | None) -> str:
    """Sort key of a URL: its host's labels reversed and joined by commas, ")", then path and query; the scheme, user,
    default port and fragment don't count, nor does the case of the host.  Null gives an empty key."""
    if not url:
        return ""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//)?", "", url).split("#", 1)[0]
    m = re.match(r"([^/?]*)(.*)", rest, re.S)
    host, path = m[1].rpartition("@")[2].lower(), m[2] or "/"
    host = re.sub(r":(80|443)?$", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (path if path[0] == "/" else f"/{path}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str | None) -> str:
    return re.sub(r"[\r\n]+", "%0A", value or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None) -> bytes:
    """One WARC record, compressed: a response, or a revisit of the page refers_to with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header(url)}", f"WARC-Payload-Digest: sha1:{digest or base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return _member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(member: bytes) -> dict:
    """Fields of a compressed record: page_id, url, type, digest, payload (None for a revisit), payload_bytes, refers_to."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page, refers = fields["WARC-Record-ID"][10:-1], fields.get("WARC-Refers-To")
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record of page {page}")
    return {
        "page_id": int(page) if page else None, "url": fields["WARC-Target-URI"], "type": fields["WARC-Type"], "digest": digest, "payload": None if revisit else payload,
        "payload_bytes": size, "refers_to": int(refers[10:-1]) if refers else None,
    }


def write(pages: DataFrame, space: Workspace, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write one record per row; returns the captures (key, page_id, file, offset, length).

    A null body is an empty payload.  Of records with equal payloads of at least min_revisit_bytes, that with the largest
    id is the response (rows that repeat this id too) and the others revisit it; a null id is below all others.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("body"), F.unhex(F.sha1(body)).alias("digest"))
    own = rows.where(F.octet_length("body") >= min_revisit_bytes).select("page_id", "digest")
    copies = own.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("digest").alias("copied"), "first")
    again = own.join(copies, own["digest"] == copies["copied"]).where("page_id is null or page_id < first")
    again = again.select(F.col("page_id").alias("again_id"), F.col("copied").alias("again_digest"), F.col("first").alias("refers_to")).distinct()
    wide = rows.join(again.hint("shuffle_hash"), rows["page_id"].eqNullSafe(again["again_id"]) & (rows["digest"] == again["again_digest"]), "left")
    base = space.at("archive")

    def run(batches):
        store, path = fs.FileSystem.from_uri(base)
        store.create_dir(path, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                out = store.open_output_stream(f"{path}/{name}", compression=None)
                info = b"software: tracemill\r\nformat: WARC File Format 1.1\r\n"
                lead = _member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{name}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
                out.write(lead)
                at = len(lead)
            found = []
            for page_id, url, text, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                member = record(page_id, url, text.encode(), refers_to, base64.b32encode(digest).decode())
                out.write(member)
                found.append((surt(url), page_id, name, at, len(member)))
                at += len(member)
            if found:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return space.save(wide.select("page_id", "url", "body", "digest", "refers_to").mapInArrow(run, "key string, page_id long, file string, offset long, length long"), "captures")


def _place(key: str, page_id: int | None) -> tuple:
    """Order of index lines: by the key's bytes, then null ids, then ids."""
    return key.encode(), page_id is not None, page_id or 0


def _shards(spark) -> int:
    return max(1, min(MAX_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def index(captures: DataFrame, space: Workspace) -> list[tuple[tuple, str]]:
    """Write the index; returns the shards' first places and files in order, MAX_SHARDS at most."""
    base = space.at("index")

    def run(batches):
        store, path = fs.FileSystem.from_uri(base)
        store.create_dir(path, recursive=True)
        name, out, at, lines, directory = f"{uuid.uuid4().hex}.idx", None, 0, [], []

        def block():
            nonlocal at
            data = _member("\n".join(json.dumps(x) for x in lines).encode())
            directory.append((*lines[0][:2], at, len(data)))
            out.write(data)
            at += len(data)
            lines.clear()

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    block()
        if out is not None:
            if lines:
                block()
            data = _member(json.dumps(directory).encode())
            out.write(data + struct.pack(_FOOTER, at, len(data)))
            out.close()
            yield pa.RecordBatch.from_pydict({"key": [directory[0][0]], "page_id": pa.array([directory[0][1]], pa.int64()), "file": [name]})

    parts = captures.repartitionByRange(_shards(captures.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id")
    found = space.save(parts.mapInArrow(run, "key string, page_id long, file string"), "shards").collect()  # a row a shard
    return sorted((_place(r["key"], r["page_id"]), r["file"]) for r in found)


class Shard:
    """One shard of the index, read by ranges."""

    def __init__(self, store, path: str):
        self.file = store.open_input_file(path)
        tail = struct.calcsize(_FOOTER)
        at, size = struct.unpack(_FOOTER, self._range(self.file.size() - tail, tail))
        self.directory = json.loads(zlib.decompress(self._range(at, size), 31))
        self.firsts = [_place(key, page_id) for key, page_id, _, _ in self.directory]
        self.held, self.lines, self.places = -1, [], []

    def _range(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def find(self, place: tuple) -> list[list]:
        """Lines at this place; equal lines may run over several blocks."""
        found, k = [], max(0, bisect.bisect_left(self.firsts, place) - 1)
        while k < len(self.firsts) and self.firsts[k] <= place:
            if self.held != k:
                data = zlib.decompress(self._range(*self.directory[k][2:]), 31)
                self.held, self.lines = k, [json.loads(x) for x in io.BytesIO(data)]
                self.places = [_place(*x[:2]) for x in self.lines]
            found += self.lines[bisect.bisect_left(self.places, place) : bisect.bisect_right(self.places, place)]
            k += 1
        return found


def lookup(wanted: DataFrame, shards: list[tuple[tuple, str]], space: Workspace) -> DataFrame:
    """The records of wanted (key, page_id), each place looked up once: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url, warc_file, warc_offset, warc_length."""
    base, archive = space.at("index"), space.at("archive")
    starts = [s[0] for s in shards]

    def run(batches):
        store, path = fs.FileSystem.from_uri(base)
        warcs, files = fs.FileSystem.from_uri(archive)[1], OrderedDict()
        at, shard = -1, None
        for batch in batches:
            rows = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = _place(key, page_id)
                k = bisect.bisect_right(starts, place) - 1
                if k < 0:
                    continue
                if k != at:
                    at, shard = k, Shard(store, f"{path}/{shards[k][1]}")
                for _, _, name, offset, length in shard.find(place):
                    if name not in files:
                        if len(files) >= OPEN_FILES:
                            files.popitem(last=False)[1].close()
                        files[name] = store.open_input_file(f"{warcs}/{name}")
                    files.move_to_end(name)
                    files[name].seek(offset)
                    r = parse(files[name].read(length))
                    rows.append((r["page_id"], r["payload_bytes"], r["digest"], r["type"], r["refers_to"], r["url"], name, offset, length))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_file string, warc_offset long, warc_length long"
    names = [x.split()[0] for x in schema.split(", ")]
    parts = wanted.distinct().repartitionByRange(_shards(wanted.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id")
    return parts.mapInArrow(run, schema)


def keys(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Lookup places (key, page_id) of pages."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(1).to_pylist()], pa.string()), batch.column(0)], names=["key", "page_id"])

    return pages.select(F.col(id_col).cast("long"), url_col).mapInArrow(run, "key string, page_id long")


def round_trip(pages: DataFrame, space: Workspace, min_revisit_bytes: int = 0) -> DataFrame:
    """Archive all pages, index the archives, and read every page back through the index: one row per page.

    Null urls have an empty key; repeated rows are separate records and each is returned; null ids stay null; very long
    pages are one record each; no rows give no rows; other columns are ignored.
    """
    shards = index(write(pages, space, min_revisit_bytes), space)
    return lookup(keys(pages), shards, space)
