"""Windows of time as columns of each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumble(df: DataFrame, ts: str, size: str) -> DataFrame:
    """df plus window_start and window_end of the window of `size` that holds ts."""
    return df.withColumn("_w", F.window(ts, size)).select("*", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end")).drop("_w")


def hop(df: DataFrame, ts: str, every: str, size: str) -> DataFrame:
    """A copy of each row for each window of `size`, one starting `every`, that holds ts."""
    return df.withColumn("_w", F.window(ts, size, every)).select("*", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end")).drop("_w")


def hop_compat(df: DataFrame, ts: str, every_us: int, size_us: int) -> DataFrame:
    """As hop, by the dialect's own rule where size is no multiple of the hop: the first window starts at
    ts truncated to the hop, minus size, plus the hop; ceil(size / hop) windows follow each other from there."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    first = t - t % every_us - size_us + every_us
    starts = F.sequence(first, first + (-(-size_us // every_us) - 1) * every_us, F.lit(every_us).cast("long"))
    out = df.withColumn("_s", F.explode(starts))
    return out.withColumns({"window_start": F.timestamp_micros("_s"), "window_end": F.timestamp_micros(F.col("_s") + size_us)}).drop("_s")
