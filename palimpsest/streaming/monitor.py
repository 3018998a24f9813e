"""Watching streams, and jobs that run again and again."""

from __future__ import annotations

import logging
import threading
import time
from collections import Counter
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

log = logging.getLogger("palimpsest")


class Monitor(StreamingQueryListener):
    """Logs what streams do and counts it: ``counts`` by (stream name, measure)."""

    def __init__(self) -> None:
        self.counts: Counter = Counter()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.counts[event.name, "starts"] += 1
        log.info("stream %s started", event.name)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.counts[p.name, "batches"] += 1
        self.counts[p.name, "rows"] += p.numInputRows
        self.counts[p.name, "millis"] += p.batchDuration

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.counts[None, "failures" if event.exception else "ends"] += 1
        if event.exception:
            log.error("a stream failed: %s", event.exception)


class Meter:
    """Durations and counters of operations. ``export`` gets each measure as it comes (name, value, tags)."""

    def __init__(self, export: Callable[[str, float, dict], None] | None = None):
        self.counts: Counter = Counter()
        self.export = export

    def record(self, name: str, value: float = 1.0, **tags) -> None:
        self.counts[name] += value
        if self.export:
            self.export(name, value, tags)

    @contextmanager
    def span(self, name: str, **tags):
        """Adds the seconds of what runs inside to ``name.duration``; a failure counts as ``name.error_total``."""
        begun = time.time()
        try:
            yield
        except Exception:
            self.record(f"{name}.error_total", 1.0, **tags)
            raise
        finally:
            self.record(f"{name}.duration", time.time() - begun, **tags)


def buffered(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 seconds") -> StreamingQuery:
    """Write micro-batches at most this often. A failed batch is tried again from the checkpoint; none is dropped.

    Batch size is the source's matter (``maxFilesPerTrigger``).
    """
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class Repeat:
    """Runs a job (retention, tiering, compaction) every so many seconds until stopped; the first run is after that time.

    A run that fails is logged and the next one still comes.
    """

    def __init__(self, job: Callable[[], object], seconds: float = 3600.0):
        self._stop, self._job, self._seconds = threading.Event(), job, seconds
        self._thread = threading.Thread(target=self._loop, daemon=True)
        self._thread.start()

    def _loop(self) -> None:
        while not self._stop.wait(self._seconds):
            try:
                self._job()
            except Exception:
                log.exception("a repeated job failed")

    def stop(self) -> None:
        self._stop.set()
        self._thread.join()
