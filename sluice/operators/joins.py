"""Joins whose keys meet null-safe, plain or bounded by lifetimes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.errors import JoinError


def null_safe_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """left and right where all pairs of columns are equal, NULL to NULL. Spark hashes and sorts by such keys as by
    plain ones; adaptive execution splits hot keys and broadcasts a side it has measured to be small."""
    if how not in ("inner", "left", "right"):
        raise JoinError(f"{how} join is not supported")
    if not on:
        raise JoinError("a join needs keys")
    return left.join(right, reduce(Column.__and__, (left[a].eqNullSafe(right[b]) for a, b in on)), how)


def with_lifetime(df: DataFrame, reference: str | Column, duration: str, prefix: str = "_ttl") -> DataFrame:
    """df with the hidden columns of a lifetime: rows live for `duration` (as '5 MINUTES') from `reference` on."""
    ref = F.col(reference) if isinstance(reference, str) else reference
    return df.withColumns({f"{prefix}_ref": ref.cast("timestamp"), f"{prefix}_dur": F.expr(f"INTERVAL {duration}")})


def alive_together(left: DataFrame, right: DataFrame, prefix: str = "_ttl") -> Column:
    l_ref, l_dur, r_ref, r_dur = (d[f"{p}_{k}"] for d, p in ((left, prefix), (right, f"{prefix}_right")) for k in ("ref", "dur"))
    return (l_ref < r_ref + r_dur) & (r_ref < l_ref + l_dur)


def ttl_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner", prefix: str = "_ttl", longest: str | None = None) -> DataFrame:
    """Rows with equal keys, each of which came while the other was alive. On streams with watermarks on the
    references, the same condition lets Spark drop state: a row is kept no longer than its lifetime.

    `longest` (as '5 MINUTES') says that no lifetime is longer. Rows then meet by key and bin of time of that size, the
    right ones in three bins each, so that the work of a key follows the rows that are near and not its whole history."""
    names = {f"{prefix}_{k}": f"{prefix}_right_{k}" for k in ("ref", "dur")}
    right = right.withColumnsRenamed(names)
    keys = reduce(Column.__and__, (left[a].eqNullSafe(right[b]) for a, b in on))
    on_time = alive_together(left, right, prefix)
    if longest is None or how == "right":
        return left.join(right, keys & on_time, how).drop(*names.values())
    width = F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {longest})")
    bins = lambda ref: F.floor(F.unix_micros(ref) / width)
    at = bins(right[f"{prefix}_right_ref"])
    binned = right.withColumn(f"{prefix}_bin", F.explode(F.sequence(at - 1, at + 1)))
    on = reduce(Column.__and__, (left[a].eqNullSafe(binned[b]) for a, b in on))
    return left.join(binned, on & (bins(left[f"{prefix}_ref"]) == binned[f"{prefix}_bin"]) & alive_together(left, binned, prefix), how).drop(*names.values(), f"{prefix}_bin")
