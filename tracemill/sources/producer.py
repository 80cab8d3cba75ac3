"""Writing trace logs from a Python program: framed archives on disk, or JSON lines to a socket.

A batch becomes one messages frame at the frontier's time and one progress frame that moves the frontier; closing a logger
retires its frontier, so a reader knows the log is complete.
"""

from __future__ import annotations

import json
import socket
from pathlib import Path

from tracemill.sources import frames


def log_path(directory: str | Path, kind: str, worker: int, replay: bool = False, extension: str = frames.EXTENSION) -> Path:
    return Path(directory) / f"{kind}.{'replay-' if replay else ''}worker-{worker}.{extension}"


class TraceLogger:
    """Frames of one worker's log in a file."""

    def __init__(self, directory: str | Path, kind: str, worker: int):
        Path(directory).mkdir(parents=True, exist_ok=True)
        self.worker, self.seq, self.time, self.size = worker, 0, 0, 0
        self.file = log_path(directory, kind, worker).open("wb")

    def _write(self, frame: dict) -> None:
        data = b"\0" * (-self.size % frames.ALIGN) + frames.encode([frame])
        self.file.write(data)
        self.size += len(data)

    def publish(self, time_ns: int, rows: list[dict]) -> None:
        """Rows carry time_ns and kind and what their kind has; worker and seq are filled in."""
        if rows:
            full = [{"worker": self.worker, "seq": self.seq + k} | r for k, r in enumerate(rows)]
            self.seq += len(rows)
            self._write(frames.messages(self.time, full))
        if time_ns != self.time:
            self._write(frames.progress([(time_ns, 1), (self.time, -1)]))
            self.time = time_ns

    def close(self) -> None:
        if not self.file.closed:
            self._write(frames.progress([(self.time, -1)]))
            self.file.close()

    def __enter__(self) -> TraceLogger:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def send(address: tuple[str, int], rows: list[dict]) -> None:
    """Rows as JSON lines to a listening reader."""
    with socket.create_connection(address) as s:
        s.sendall("".join(json.dumps(r) + "\n" for r in rows).encode())
