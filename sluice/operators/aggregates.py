"""Aggregates as columns, and their forms over signed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.errors import ChangelogError


def max_value(key: str, value: str, seq: str | None = None) -> Column:
    """The value of the row with the greatest key; rows without a key are skipped; among equals the last in seq counts."""
    order = F.struct(key, seq) if seq else F.col(key)
    return F.max_by(value, F.when(F.col(key).isNotNull(), order))


def min_value(key: str, value: str, seq: str | None = None) -> Column:
    order = F.struct(F.col(key), -F.col(seq)) if seq else F.col(key)
    return F.min_by(value, F.when(F.col(key).isNotNull(), order))


def last_touch(value: str, seq: str) -> Column:
    """The value in the last row of the group that was touched."""
    return F.max_by(value, seq)


def append_only(changes: DataFrame, op: str = "_op") -> DataFrame:
    """changes, failing when they hold anything but insertions."""
    return changes.where(F.when(F.col(op) != "I", F.raise_error(F.lit("update or delete on an append-only aggregate")).cast("boolean")).otherwise(F.lit(True)))


def signed_aggregates(rows: DataFrame, by: list[str], sums: list[str], sign: str = "_sign") -> DataFrame:
    """Per group of signed rows: _count, and sum_<c> of each column, groups without rows left out. Linear in the rows,
    so partial sums of any batches add up; a count below 0 fails."""
    out = rows.groupBy(*by).agg(F.sum(sign).alias("_count"), *[F.sum(F.col(c) * F.col(sign)).alias(f"sum_{c}") for c in sums])
    ok = F.when(F.col("_count") < 0, F.raise_error(F.lit("more deletions than insertions")).cast("boolean")).otherwise(F.col("_count") > 0)
    return out.where(ok)


def signed_extremes(rows: DataFrame, by: list[str], column: str, sign: str = "_sign") -> DataFrame:
    """Per group of signed rows: min_<c> and max_<c> over the values that are still there, by a count per value."""
    values = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.sum(sign).alias("_n")).where("_n > 0")
    return values.groupBy(*by).agg(F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))


def check_no_negative(count: int) -> None:
    if count < 0:
        raise ChangelogError("more deletions than insertions")
