"""The page queue as a stream: bounded batches, back-pressure on whoever fills it, and a drain that ends between batches."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def page_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """The page queue: files in the order of their times, a bounded number each time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


class Gate(StreamingQueryListener):
    """Keeps the queue between its marks: producers ask `wait` before they put pages, the stream's progress takes them off.

    The pages of each batch are counted by an observed metric while the batch runs, at no cost of its own, and are
    taken off when its progress says that it is committed. What was put before the gate was made is given as `waiting`.
    """

    def __init__(self, name: str = "page_queue", high: int = 5000, waiting: int = 0):
        self.name, self.high = name, high
        self.put_, self.taken, self.batches = waiting, 0, 0
        self.changed = threading.Condition()

    def watch(self, pages: DataFrame) -> DataFrame:
        """The stream with its pages counted; start what is made of it while this listener is added to the session's."""
        return pages.observe(self.name, F.count(F.lit(1)).alias("pages"))

    @property
    def waiting(self) -> int:
        """Pages that were put and that no committed batch has taken."""
        return self.put_ - self.taken

    def put(self, n: int) -> None:
        with self.changed:
            self.put_ += n

    def wait(self, n: int, timeout: float | None = None) -> bool:
        """Wait until n more pages fit below the mark (or the queue is empty, for more than that); False at the timeout."""
        with self.changed:
            return self.changed.wait_for(lambda: self.waiting + n <= self.high or self.waiting <= 0, timeout)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.changed.notify_all()

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            with self.changed:
                self.taken += row["pages"]
                self.batches += 1
                self.changed.notify_all()


class Drained(RuntimeError):
    """Ends a query before a batch that came after the request to stop."""


class Drain:
    """Stops a stream between two batches: the batch at hand ends and is committed, the next one is not begun.

    Wrap the batch function with `guard`. The batch that is not begun stays in the queue: a restart from the checkpoint takes it first.
    """

    def __init__(self):
        self.stopping = threading.Event()

    def guard(self, each):
        def begin(batch: DataFrame, batch_id: int) -> None:
            if self.stopping.is_set():
                raise Drained(f"batch {batch_id} is left in the queue")
            each(batch, batch_id)

        return begin

    def stop(self, query: StreamingQuery, timeout: float = 60) -> None:
        """Let the batch at hand end, then stop the query; its own failure is raised."""
        self.stopping.set()
        end = time.monotonic() + timeout
        while query.isActive:
            if not query.status["isTriggerActive"]:
                query.stop()
                break
            if time.monotonic() > end:
                raise TimeoutError("the batch at hand did not end")
            time.sleep(0.05)
        if (failed := query.exception()) and Drained.__name__ not in str(failed):
            raise failed
