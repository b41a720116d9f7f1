"""Views kept up to date from streams of changes."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.changelog import diff, fold
from sluice.shipping import ship


class View:
    """A query over folded change logs, maintained batch by batch with foreachBatch.

    Each micro-batch appends its changes to the log of its table (Parquet under `store`, one folder a batch, so that a
    repeated batch overwrites itself), runs the query over the folded logs and writes the signed rows by which the
    result differs from the one before. Any query of the engine can be kept this way, deletions included.
    """

    def __init__(self, spark: SparkSession, store: str, tables: dict[str, tuple[T.StructType, list[str]]], query: Callable[[dict[str, DataFrame]], DataFrame]):
        self.spark, self.store, self.tables, self.query = spark, store.rstrip("/"), tables, query

    def _log(self, name: str) -> DataFrame:
        from sluice.operators.changelog import schema

        kind = T.StructType([*schema(self.tables[name][0]).fields, T.StructField("batch", T.LongType())])
        path = f"{self.store}/log/{name}"
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jvm.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(jvm):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(path)

    def state(self, upto: int | None = None) -> dict[str, DataFrame]:
        out = {}
        for name, (_, key) in self.tables.items():
            log = self._log(name)
            out[name] = fold((log if upto is None else log.where(F.col("batch") <= upto)).drop("batch"), key)
        return out

    def result(self, upto: int | None = None) -> DataFrame:
        return self.query(self.state(upto))

    def apply(self, name: str, changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{self.store}/log/{name}/batch={batch}")

    def changes(self, batch: int) -> DataFrame:
        """The signed rows that batch brought about."""
        return diff(self.result(batch - 1), self.result(batch))

    def writer(self, name: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch of the stream of table `name`, where it is the only stream."""

        def write(changes: DataFrame, batch: int) -> None:
            self.apply(name, changes, batch)
            self.changes(batch).write.mode("overwrite").parquet(f"{self.store}/out/batch={batch}")

        return write

    def output(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.store}/out")


def retractable_counts(changes: DataFrame, by: str, value: str, checkpoint: str | None = None) -> DataFrame:
    """A stream of signed rows (by, value, _sign) -> a stream of signed rows (by, n, total): whenever a group changes, its
    old count and sum with _sign -1 and the new with +1. State is two numbers per group, kept by transformWithState."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    ship(changes.sparkSession)
    kind = changes.schema[by].dataType.simpleString()

    class Counts(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("sums", "n long, total double")

        def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
            import pandas as pd

            n0, t0 = self.state.get() if self.state.exists() else (0, 0.0)
            n, t = n0, t0
            for pdf in rows:
                n += int(pdf["sign"].sum())
                t += float((pdf["sign"] * pdf["v"].fillna(0)).sum())
            if n < 0:
                raise ValueError(f"more deletions than insertions in group {key}")
            out = [(key[0], n0, t0, -1)] * (n0 > 0) + [(key[0], n, t, 1)] * (n > 0)
            if n:
                self.state.update((n, t))
            else:
                self.state.clear()
            if (n0, t0) != (n, t) and out:
                yield pd.DataFrame(out, columns=[by, "n", "total", "_sign"])

        def close(self) -> None:
            pass

    changes = changes.select(by, F.col(value).cast("double").alias("v"), F.col("_sign").cast("long").alias("sign"))
    return changes.groupBy(by).transformWithStateInPandas(Counts(), f"`{by}` {kind}, n long, total double, _sign int", "Update", "None")


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that an availableNow run of stream puts out, as a table under `folder`. Rows of an update or complete run
    carry _batch; of complete runs the last batch counts."""
    spark = stream.sparkSession

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(os.path.join(folder, "out", f"b{batch:09d}"))

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", os.path.join(folder, "checkpoint")).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    kind = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    out = spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(os.path.join(folder, "out"))
    if mode == "complete":
        last = out.agg(F.max("_batch")).first()[0]
        out = out.where(F.col("_batch") == last)
    return out
