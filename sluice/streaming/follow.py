"""Scripts kept up to date from streams of changes, epoch by epoch, over restarts."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators import changelog
from sluice.sinks.sinks import Replication
from sluice.sources.files import Marked

#: Before every change: the place of rows that a table held when the epoch began.
BEFORE = -(1 << 63)


class Feed:
    """A source's change log: a stream, a snapshot that is read once, or files by their markers; and the key of its rows.
    Without a key, rows count as often as they came more than they went."""

    def __init__(self, changes: DataFrame | Marked, key: list[str] | None = None):
        self.changes, self.key = changes, key or None
        self.row: T.StructType = changes.schema if isinstance(changes, Marked) else changes.schema["new"].dataType


class Follower:
    """Tables from `feeds`, the outputs that `plan` makes of them, and `sinks` that get the signed rows of each output.

    An epoch takes what is new in every source, folds it into the sources' tables, runs the plan over these and gives the
    rows by which each output differs from before to its sinks: write(changes, result, epoch). An epoch without news does
    nothing. All is kept in versioned folders under `home`, which executors must reach; an epoch counts once `epochs`
    names it. After a stop at any point a new Follower does the open epoch again, and gives the last one to the sinks
    once more if `delivered` does not name it: sinks must take a repeated epoch as one. A change in a later epoch is the
    later one, whatever its _seq; within an epoch _seq decides. An epoch's cost follows the tables, not the log's age.
    """

    def __init__(self, spark: SparkSession, home: str, feeds: dict[str, Feed], plan: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], sinks: list[tuple[str, Callable[[DataFrame, DataFrame, int], None]]]):
        self.spark, self.home, self.feeds, self.plan, self.sinks = spark, home.rstrip("/"), feeds, plan, sinks
        self.epochs, self.delivered = Replication(spark, self.home, "epochs"), Replication(spark, self.home, "delivered")
        last = self.epochs.last()
        if last > self.delivered.last():
            self._deliver(last)

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def _versions(self, kind: str, name: str, upto: int) -> list[int]:
        p, fs = self._path(f"{self.home}/{kind}/{name}")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(v for v in (int(n[1:]) for n in names if re.fullmatch(r"e\d+", n)) if v <= upto)

    def _folder(self, kind: str, name: str, epoch: int) -> str:
        return f"{self.home}/{kind}/{name}/e{epoch:09d}"

    def _latest(self, kind: str, name: str, upto: int, schema: T.StructType | None = None) -> DataFrame | None:
        found = self._versions(kind, name, upto)
        if not found:
            return None
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(self._folder(kind, name, found[-1]))

    def _take(self, name: str, feed: Feed, epoch: int) -> None:
        """What is new in a source, as the log of this epoch, a folder a batch: a batch that comes again overwrites itself."""
        log = self._folder("log", name, epoch)
        if isinstance(feed.changes, Marked):
            if (rows := feed.changes.poll()) is not None:
                changelog.inserts(rows).write.mode("overwrite").parquet(f"{log}/b{len(feed.changes.given()):09d}")
                feed.changes.done()
        elif not feed.changes.isStreaming:
            if not self._versions("state", name, epoch - 1):
                feed.changes.write.mode("overwrite").parquet(f"{log}/b{0:09d}")
        else:
            write = lambda df, batch: df.write.mode("overwrite").parquet(f"{log}/b{batch:09d}")
            q = feed.changes.writeStream.queryName(f"{name}-{epoch}").option("checkpointLocation", f"{self.home}/checkpoint/{name}").trigger(availableNow=True).foreachBatch(write).start()
            q.awaitTermination()

    def _fold(self, name: str, feed: Feed, epoch: int) -> None:
        kind = changelog.schema(feed.row)
        log = self.spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(self._folder("log", name, epoch))
        before = self._latest("state", name, epoch - 1, feed.row)
        if before is not None:
            held = changelog.inserts(before).withColumn("_seq", F.lit(BEFORE).cast("long"))
            log = held.unionByName(log)
        changelog.fold(log, feed.key).write.mode("overwrite").parquet(self._folder("state", name, epoch))

    def tables(self, epoch: int) -> dict[str, DataFrame]:
        """The sources' tables as they stood after that epoch, which is one of the last two."""
        found = {name: self._latest("state", name, epoch, feed.row) for name, feed in self.feeds.items()}
        return {name: self.spark.createDataFrame([], self.feeds[name].row) if t is None else t for name, t in found.items()}

    def _deliver(self, epoch: int) -> None:
        for name, write in self.sinks:
            write(self._latest("changes", name, epoch), self._latest("result", name, epoch), epoch)
        self.delivered.took(epoch)

    def step(self) -> bool:
        """One epoch; False if no source had anything new."""
        epoch = self.epochs.last() + 1
        for name, feed in self.feeds.items():
            self._take(name, feed, epoch)
        news = [name for name in self.feeds if self._exists(self._folder("log", name, epoch))]
        if not news:
            return False
        for name in news:
            self._fold(name, self.feeds[name], epoch)
        outputs = self.plan(self.tables(epoch))
        for name, out in outputs.items():
            out.write.mode("overwrite").parquet(self._folder("result", name, epoch))
            before, after = self._latest("result", name, epoch - 1), self._latest("result", name, epoch)
            changes = after.withColumn("_sign", F.lit(1)) if before is None else changelog.diff(before, after)
            changes.write.mode("overwrite").parquet(self._folder("changes", name, epoch))
        self.epochs.took(epoch)
        self._deliver(epoch)
        for kind, names in (("log", self.feeds), ("state", self.feeds), ("result", outputs), ("changes", outputs)):
            for name in names:
                for old in self._versions(kind, name, epoch)[:-2]:
                    p, fs = self._path(self._folder(kind, name, old))
                    fs.delete(p, True)
        return True

    def run(self, interval: float = 1.0, stop: Callable[[], bool] | None = None) -> None:
        """Epoch after epoch until stop() says so, with a pause where nothing is new."""
        while not (stop and stop()):
            if not self.step():
                time.sleep(interval)
