"""What running streams report: rows, watermarks, completion."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def watermark(query: StreamingQuery) -> str | None:
    """The event-time frontier after the last batch, if the query has one."""
    last = query.lastProgress
    return dict(last.get("eventTime") or {}).get("watermark") if last else None


class Status(StreamingQueryListener):
    """Counts batches and rows of each query, for a status line or a stop condition."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event):
        self.rows[str(event.id)] = self.batches[str(event.id)] = 0

    def onQueryProgress(self, event):
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows
        self.batches[key] = self.batches.get(key, 0) + 1

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.add(str(event.id))

    def line(self) -> str:
        return ", ".join(f"{k[:8]}: {n} rows in {self.batches[k]} batches" + " (ended)" * (k in self.ended) for k, n in self.rows.items())
