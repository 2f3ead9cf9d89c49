"""What passed, what was bad and what came too late, counted without a pass of its own."""

from __future__ import annotations

import threading
from collections import Counter, defaultdict

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class RecordCounts(StreamingQueryListener):
    """Sums of ``count_records`` over the micro-batches of all streams of a session, by name.

    ``late`` counts the rows that operators with state dropped behind the watermark, by query id.
    A batch that comes again counts again.
    """

    def __init__(self) -> None:
        self.counts: dict[str, Counter] = defaultdict(Counter)
        self.late: Counter = Counter()
        self._lock = threading.Lock()

    def start(self, spark: SparkSession) -> RecordCounts:
        spark.streams.addListener(self)
        return self

    def stop(self, spark: SparkSession) -> None:
        spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._lock:
            for name, row in event.progress.observedMetrics.items():
                self.counts[name].update(row.asDict())
            self.late[str(event.progress.id)] += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
