"""Asynchronous ingest: a queue folder of pending documents, and the streaming query that takes them into a store."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.maintenance import latest
from ..sources.store import InvalidPath, StoreError, VectorStore, _Files

PENDING = "path string, contents string, seq long"
CAPACITY = 63


class NotQueuedShuttingDown(StoreError):
    pass


class Full(StoreError):
    pass


def start(store: VectorStore, stream: DataFrame, checkpoint: str, name: str = "ingest", available_now: bool = True, taken: Callable[[int], None] | None = None):
    """Runs ``store.ingest`` on each micro-batch.  A batch that comes again after a failure is skipped by its number.

    With ``available_now`` the query ends when all that is there is taken, else it goes on in the
    background.  ``taken`` is told the greatest ``seq`` of each batch when it is in the store.  A batch that fails
    ends the query, and is the first to be taken when it is started again.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        rows = batch.where("path is not null and path <> ''").select("path", "contents", "seq")
        last = rows.agg(F.max("seq")).first()[0]
        if last is None:
            return
        store.ingest(latest(rows), name, epoch)
        if taken:
            taken(last)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).queryName(f"{name}_{uuid.uuid4().hex[:6]}")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="200 milliseconds")).start()


class IngestQueue:
    """Documents to be ingested later, in the order of pushing; of one path the last counts.

    At most ``capacity`` paths may be pending.  Pending documents are files, which outlive the process; a
    queue on the same folder goes on with them, and with numbers above theirs.  ``run`` takes them in the
    background while callers push; without it they wait for ``drain`` or ``shutdown``.
    """

    def __init__(self, store: VectorStore, folder: str, capacity: int = CAPACITY):
        self.store, self.folder, self.capacity = store, folder.rstrip("/"), capacity
        self._files = _Files(store.spark, self.folder)
        self._files.fs.mkdirs(self._files._path("pending"))
        self._open, self._running, self._lock = True, None, threading.Lock()
        self._pending: dict[str, int] = {}  # the number of each path's last document
        for name in self._names():
            row = json.loads(self._files.read(f"pending/{name}"))
            self._pending[row["path"]] = max(row["seq"], self._pending.get(row["path"], 0))
        self._seq = max(self._pending.values(), default=0)

    def _names(self) -> list[str]:
        names = (x.getPath().getName() for x in self._files.fs.listStatus(self._files._path("pending")))
        return [n for n in names if n.endswith(".json")]

    def push(self, path: str, contents: str) -> None:
        """Returns at once; an empty path, a queue that is shut down, and a new path in a full queue are refused."""
        if not path:
            raise InvalidPath("the path is empty")
        with self._lock:
            if not self._open:
                raise NotQueuedShuttingDown(path)
            if path not in self._pending and len(self._pending) >= self.capacity:
                raise Full(path)
            self._seq = max(self._seq + 1, time.time_ns())
            self._pending[path] = self._seq
            self._files.replace(f"pending/{self._seq:020d}-{uuid.uuid4().hex[:8]}.json", json.dumps({"path": path, "contents": contents, "seq": self._seq}))

    def _taken(self, last: int) -> None:
        with self._lock:
            self._pending = {p: n for p, n in self._pending.items() if n > last}

    def _start(self, available_now: bool):
        spark = self.store.spark
        pending = spark.readStream.schema(PENDING).option("pathGlobFilter", "*.json").json(f"{self.folder}/pending")
        return start(self.store, pending, f"{self.folder}/checkpoint", f"queue {self.folder}", available_now, self._taken)

    def _clear(self) -> None:
        """Deletes the files of documents that are in the store; no query may be reading."""
        with self._lock:
            least = min(self._pending.values(), default=self._seq + 1)
            for name in self._names():
                if int(name.split("-")[0]) < least:
                    self._files.delete(f"pending/{name}")

    def run(self):
        """Takes what is pending, and what is pushed from now on, in the background."""
        if self._running is None or not self._running.isActive:
            self._running = self._start(False)
        return self._running

    def drain(self) -> None:
        """Ingests all that is pending."""
        if self._running is not None:
            self._running.processAllAvailable()
            return
        self._start(True).awaitTermination()
        self._clear()

    def shutdown(self) -> None:
        """Accepts no more, ingests what is pending, and ends what runs in the background."""
        with self._lock:
            self._open = False
        self.drain()
        if self._running is not None:
            self._running.stop()
            self._running = None
            self._clear()


def latest_events(events: DataFrame, key: str, contents: str, order: list[str]) -> DataFrame:
    """The state that a queue leaves: for each key the contents of its last event."""
    best = events.groupBy(key).agg(F.max_by(F.struct(*events.columns), F.struct(*order)).alias("best"), F.count("*").alias("pushed"))
    return best.select(F.col(key).alias("path"), F.col(f"best.{contents}").alias("contents"), "pushed")
