"""Logs of running programs: a listener that takes so many connections and keeps what they send until they close.

A program connects once per worker.  What it sends, JSON lines or frames, goes to one file a connection, unchanged, in a
folder that read_log() reads.  The listener runs where it is started; only bytes pass through it.
"""

from __future__ import annotations

import socket
import threading
import time

from pyarrow import fs

_PIECE = 1 << 16


class Listener:
    """Accepts `connections` connections at an address (port 0: any free one) and stores them under folder (a URI)."""

    def __init__(self, address: str, kind: str, folder: str, connections: int = 1, encoding: str = "json"):
        host, _, port = address.rpartition(":")
        self.server = socket.create_server((host or "127.0.0.1", int(port)))
        self.address = self.server.getsockname()[:2]
        self.kind, self.connections, self.encoding = kind, connections, encoding
        self.files, self.path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        self.files.create_dir(self.path)
        self.stopped, self.bytes = threading.Event(), [0] * connections
        self.threads = [threading.Thread(target=self._keep, args=(n,), daemon=True) for n in range(connections)]
        for thread in self.threads:
            thread.start()

    def _keep(self, n: int) -> None:
        self.server.settimeout(0.2)
        connection = None
        while connection is None and not self.stopped.is_set():
            try:
                connection, _ = self.server.accept()
            except TimeoutError:
                continue
            except OSError:
                return
        if connection is None:
            return
        with connection, self.files.open_output_stream(f"{self.path}/{self.kind}.worker-{n}.{self.encoding}") as out:
            connection.settimeout(0.2)
            while not self.stopped.is_set():
                try:
                    piece = connection.recv(_PIECE)
                except TimeoutError:
                    continue
                if not piece:
                    return
                out.write(piece)
                self.bytes[n] += len(piece)

    def wait(self, seconds: float | None = None) -> bool:
        """Until all connections have come and closed, or for so long; whether they have."""
        end = None if seconds is None else time.monotonic() + seconds
        for thread in self.threads:
            thread.join(None if end is None else max(0.0, end - time.monotonic()))
        done = not any(t.is_alive() for t in self.threads)
        self.stop()
        return done

    def stop(self) -> None:
        self.stopped.set()
        for thread in self.threads:
            thread.join()
        self.server.close()


def record(addresses: dict[str, str], folder: str, connections: int = 1, encoding: str = "json", seconds: float | None = None) -> dict[str, bool]:
    """Listen for every kind of log at once; whether each one's sources have closed."""
    listeners = {kind: Listener(address, kind, folder, connections, encoding) for kind, address in addresses.items()}
    end = None if seconds is None else time.monotonic() + seconds
    return {kind: x.wait(None if end is None else max(0.0, end - time.monotonic())) for kind, x in listeners.items()}
