"""UNION and UNION ALL, of tables and of signed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.errors import SetError


def _meets(a: DataFrame, b: DataFrame) -> None:
    if len(a.columns) != len(b.columns):
        raise SetError(f"{len(a.columns)} and {len(b.columns)} columns")


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    _meets(a, b)
    return a.unionAll(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    _meets(a, b)
    return a.unionAll(b).distinct()


def signed_union(a: DataFrame, b: DataFrame, sign: str = "_sign") -> DataFrame:
    """The rows that are in either of two signed inputs more than they went."""
    _meets(a, b)
    rows = a.unionByName(b)
    return rows.groupBy(*[c for c in rows.columns if c not in (sign, "_seq")]).agg(F.sum(sign).alias("_n")).where("_n > 0").drop("_n")
