"""Counters and latencies of running streams."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class Telemetry(StreamingQueryListener):
    """Per query name: operations so far, rate, and the latency of the last batch. Register with spark.streams.addListener."""

    def __init__(self):
        self.operations: dict[str, int] = {}
        self.rate: dict[str, float] = {}
        self.pipeline_latency: dict[str, float] = {}
        self.total_latency: dict[str, list[float]] = {}
        self.failed: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.operations.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        name = p.name or str(p.id)
        self.operations[name] = self.operations.get(name, 0) + p.numInputRows
        self.rate[name] = p.processedRowsPerSecond
        took = p.durationMs.get("triggerExecution", 0) / 1000
        self.pipeline_latency[name] = took
        self.total_latency.setdefault(name, []).append(took)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.failed[str(event.id)] = event.exception
