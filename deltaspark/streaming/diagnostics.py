"""Progress of running streams, as rows."""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class ProgressLog(StreamingQueryListener):
    """Keeps the last `most` progress reports of all queries of a session."""

    def __init__(self, most: int = 1000):
        self.reports: deque = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        self.reports.append({"kind": "started", "id": str(event.id), "name": event.name})

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        self.reports.append({"kind": "progress", "id": p["id"], "batch": p["batchId"], "rows": p.get("numInputRows", 0), "ms": p.get("durationMs", {}).get("triggerExecution", 0), "state": p.get("stateOperators", [])})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.reports.append({"kind": "ended", "id": str(event.id), "error": event.exception})


def watch(spark: SparkSession, most: int = 1000) -> ProgressLog:
    log = ProgressLog(most)
    spark.streams.addListener(log)
    return log
