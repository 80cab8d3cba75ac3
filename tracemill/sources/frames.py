"""Framed event archives as a data source.

A file is a sequence of frames: zero bytes up to the next multiple of 16, the payload's length as a little-endian 128-bit
number, the payload.  A payload is JSON, either {"messages": [capability_ns, [row, ...]]} or {"progress": [[time_ns, diff], ...]}.
Rows of messages become table rows with their capability time; progress frames only move watermarks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ALIGN = 16
#: Extension of archive files, unless the reader is told another (option `extension`).
EXTENSION = "frames"


def encode(frames: list[dict]) -> bytes:
    out = bytearray()
    for frame in frames:
        out += b"\0" * (-len(out) % ALIGN)
        payload = json.dumps(frame, separators=(",", ":")).encode()
        out += len(payload).to_bytes(16, "little") + payload
    return bytes(out)


def messages(capability_ns: int, rows: list[dict]) -> dict:
    return {"messages": [capability_ns, rows]}


def progress(changes: list[tuple[int, int]]) -> dict:
    return {"progress": [list(c) for c in changes]}


def decode(stream) -> Iterator[dict]:
    """Frames of a file-like object; a cut-off last frame is an error."""
    at = 0
    while True:
        pad = -at % ALIGN
        head = stream.read(pad + 16)
        if not head.strip(b"\0") and len(head) < pad + 16:
            return
        if len(head) < pad + 16:
            raise ValueError(f"cut-off frame at byte {at}")
        size = int.from_bytes(head[pad:], "little")
        payload = stream.read(size)
        if len(payload) < size:
            raise ValueError(f"cut-off frame at byte {at}")
        at += pad + 16 + size
        yield json.loads(payload)


def _signed(value):
    """Numbers from 2**63 on, which ids may be, as the signed number of the same bits; lists alike."""
    if isinstance(value, list):
        return [_signed(x) for x in value]
    return value - (1 << 64) if isinstance(value, int) and not isinstance(value, bool) and value >= 1 << 63 else value


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


def _listed(path: str, kind: str, extension: str) -> list[str]:
    store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    prefix = path.split("://", 1)[0] + "://" if "://" in path else "file://"
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and PurePosixPath(f.path).name.split(".")[0] == kind and f.path.endswith(f".{extension}"))


class FrameReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        self.paths, self.kind = options["path"].split(","), options.get("kind", "timely")
        self.extension = options.get("extension", EXTENSION)

    def partitions(self):
        """A file is a partition, as frames can only be followed from a file's start."""
        return [_File(f) for p in self.paths for f in _listed(p, self.kind, self.extension)] or [_File("")]

    def read(self, partition):
        if not partition.value:
            return
        store, path = fs.FileSystem.from_uri(partition.value)
        with store.open_input_stream(path, compression=None) as stream:
            for frame in decode(stream):
                if "messages" in frame:
                    capability, rows = frame["messages"]
                    for row in rows:
                        yield tuple(_signed(row.get(n, capability if n == "capability_ns" else None)) for n in self.names)


class FrameSource(DataSource):
    @classmethod
    def name(cls):
        return "frames"

    def schema(self):
        from tracemill import schemas

        return schemas.LOGS[self.options.get("kind", "timely")]

    def reader(self, schema):
        return FrameReader(schema, dict(self.options))
