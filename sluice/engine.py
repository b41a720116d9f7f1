"""Runs scripts: registers sources and functions with Spark, rewrites the script, hands it to Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import PipelineError, UnknownFunction
from sluice.functions import python as python_functions
from sluice.plans.rewrite import Options, Query, rewrite
from sluice.shipping import ship
from sluice.types import spark_type


class Engine:
    """Tables by name, user functions, and what a script makes of them.

    `compat` and `extended` are the modes of sluice.plans.rewrite.Options. Errors of expressions (a bad cast, division
    by zero) fail the query; with `tolerant` they give NULL instead. Tables are DataFrames, streaming or not; nothing
    is read until a result is used.
    """

    def __init__(self, spark: SparkSession, compat: bool = False, extended: bool = False, tolerant: bool = False):
        self.spark, self.compat, self.extended, self.tolerant = spark, compat, extended, tolerant
        self.python: dict[str, Callable] = {}
        self.udfs: set[str] = set()
        ship(spark)
        python_functions.register(spark)

    def table(self, name: str, df: DataFrame) -> Engine:
        df.createOrReplaceTempView(name)
        return self

    def function(self, name: str, f: Callable) -> Engine:
        """A Python function for typed calls, name<type>(...); it takes one value for each argument."""
        self.python[name] = f
        return self

    def udf(self, name: str, registered) -> Engine:
        """A Spark function (as from F.udf or F.pandas_udf) to call by name."""
        self.spark.udf.register(name, registered)
        self.udfs.add(name)
        return self

    def _typed(self, options: Options) -> None:
        for name, kind in options.typed:
            if name not in self.python:
                raise UnknownFunction(name)
            out = spark_type({"integer": "Int", "bigint": "Int"}.get(kind, kind))
            f = self.python[name]
            to = float if isinstance(out, T.DoubleType) else int if isinstance(out, (T.LongType, T.ByteType)) else (lambda v: v)
            self.spark.udf.register(f"{name}__{kind}", F.udf(lambda *a, f=f, to=to: None if (r := f(*a)) is None else to(r), out, useArrow=True))

    def rewrite(self, script: str) -> list[Query]:
        options = Options(self.compat, self.extended, set(self.udfs))
        out = rewrite(script, options)
        self._typed(options)
        return out

    def _planned(self, sql: str) -> DataFrame:
        """Spark fixes how errors are met when it analyses a query, so the setting is needed here alone."""
        before = self.spark.conf.get("spark.sql.ansi.enabled")
        self.spark.conf.set("spark.sql.ansi.enabled", str(not self.tolerant).lower())
        try:
            return self.spark.sql(sql)
        finally:
            self.spark.conf.set("spark.sql.ansi.enabled", before)

    def run(self, script: str) -> dict[str, DataFrame]:
        """The output tables of a script, by their INTO names. A statement without INTO is an error, as nothing could use it."""
        out = {}
        for q in self.rewrite(script):
            if not q.into:
                raise PipelineError("SELECT needs INTO")
            out[q.into] = self._planned(q.sql)
        return out

    def query(self, sql: str) -> DataFrame:
        """The result of one query, with or without INTO."""
        found = self.rewrite(sql)
        if len(found) != 1:
            raise PipelineError(f"{len(found)} statements where one is due")
        return self._planned(found[0].sql)

    def validate(self, script: str) -> dict[str, T.StructType]:
        """The schemas of a script's output tables; raises what is wrong with it. Reads no data."""
        return {name: df.schema for name, df in self.run(script).items()}
