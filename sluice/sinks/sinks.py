"""Where results go: counted and dropped, signed rows for collapsing tables, or a table kept by key."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import ConfigError


class Dummy:
    """Counts rows and drops them. With a column inserted_at, the latency of the latest row is noted too."""

    def __init__(self):
        self.rows, self.began, self.latency = 0, time.time(), None

    def __call__(self, df: DataFrame, batch: int = 0) -> None:
        seen = [F.count(F.lit(1)).alias("n")]
        if "inserted_at" in df.columns:
            seen.append((F.unix_micros(F.current_timestamp()) - F.max(F.unix_micros(F.col("inserted_at").cast("timestamp")))).alias("late"))
        got = df.agg(*seen).first()
        self.rows += got["n"]
        if "inserted_at" in df.columns and got["late"] is not None:
            self.latency = got["late"] / 1e6

    @property
    def rate(self) -> float:
        return self.rows / max(1e-9, time.time() - self.began)


def clickhouse_type(kind: T.DataType, nullable: bool = True) -> str:
    """The column type of ClickHouse for a Spark type."""
    if isinstance(kind, T.DecimalType):
        out = {(20, 0): "UInt64", (38, 0): "Int128"}.get((kind.precision, kind.scale), f"Decimal({kind.precision}, {kind.scale})")
    else:
        out = {T.LongType: "Int64", T.IntegerType: "Int32", T.ShortType: "Int16", T.ByteType: "Int8", T.DoubleType: "Float64", T.FloatType: "Float32", T.BooleanType: "Bool", T.StringType: "String", T.BinaryType: "String", T.DateType: "Date", T.TimestampType: "DateTime64(6)", T.TimestampNTZType: "DateTime64(6)", T.DayTimeIntervalType: "Int64", T.VariantType: "JSON"}.get(type(kind))
        if isinstance(kind, T.StructType) and [f.name for f in kind.fields] == ["x", "y"]:
            return "Point"
    if out is None:
        raise ConfigError(f"no column type for {kind.simpleString()}")
    return f"Nullable({out})" if nullable else out


def clickhouse_ddl(table: str, schema: T.StructType, key: list[str], engine: str = "CollapsingMergeTree(sign)", partition_by: str | None = None, cluster: str | None = None) -> str:
    """CREATE TABLE for a sink; a collapsing table gets a sign column."""
    columns = [f"`{f.name}` {clickhouse_type(f.dataType, f.nullable and f.name not in key)}" for f in schema]
    if engine.startswith("CollapsingMergeTree"):
        columns.append("`sign` Int8")
    out = f"CREATE TABLE IF NOT EXISTS `{table}`" + (f" ON CLUSTER `{cluster}`" if cluster else "") + f" ({', '.join(columns)}) ENGINE = {engine}"
    out += f" ORDER BY ({', '.join(f'`{k}`' for k in key)})" if key else " ORDER BY tuple()"
    return out + (f" PARTITION BY {partition_by}" if partition_by else "")


def signed_rows(changes: DataFrame, collapsing: bool = True) -> DataFrame:
    """What a sink appends for signed rows: the row and its sign. A table that doesn't collapse takes insertions alone."""
    if collapsing:
        return changes.withColumn("sign", F.col("_sign").cast("tinyint")).drop("_sign", "_seq")
    ok = F.when(F.col("_sign") < 0, F.raise_error(F.lit("this table takes no updates or deletions")).cast("boolean")).otherwise(F.lit(True))
    return changes.where(ok).drop("_sign", "_seq")


class Replication:
    """The last batch that a sink has taken, by table, under `path`; a batch that comes again is left out."""

    def __init__(self, spark: SparkSession, path: str, table: str):
        self.spark, self.path, self.table = spark, f"{path.rstrip('/')}/{table}", table

    def last(self) -> int:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return -1
        return self.spark.read.parquet(self.path).agg(F.max("txid")).first()[0]

    def took(self, batch: int) -> None:
        self.spark.createDataFrame([(self.table, batch)], "table string, txid long").coalesce(1).write.mode("append").parquet(self.path)


def jdbc_writer(url: str, table: str, collapsing: bool = True, replication: Replication | None = None, **options: str):
    """For foreachBatch: appends signed rows by JDBC, in batches of 100 unless options say otherwise."""

    def write(df: DataFrame, batch: int) -> None:
        if replication and batch <= replication.last():
            return
        signed_rows(df, collapsing).write.format("jdbc").option("url", url).option("dbtable", table).options(**{"batchsize": "100"} | options).mode("append").save()
        if replication:
            replication.took(batch)

    return write


class Upsert:
    """A table kept by key from signed rows, one folder a version, of which the last two stay; a batch that comes again
    changes nothing, in a new process neither.

    on_insert, on_update and on_delete say what to do where a row is or isn't there: 'nothing', 'update' or 'panic'.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], on_insert: str = "update", on_update: str = "update", on_delete: str = "nothing"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.policy = {"insert": on_insert, "update": on_update, "delete": on_delete}
        self.version = max(self._versions(), default=None)  # a new process goes on where the last one stopped

    def _folder(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """The versions under path that were written to their end."""
        path, fs = self._folder()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        done = lambda n: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return [int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and done(n)]

    def table(self) -> DataFrame | None:
        return None if self.version is None else self.spark.read.parquet(f"{self.path}/v{self.version}")

    def _met(self, rows: DataFrame, keys: DataFrame) -> list[Column]:
        """The keys of rows are those in keys (_k0, _k1 ...); NULL is a key like others."""
        return [rows[k].eqNullSafe(keys[f"_k{i}"]) for i, k in enumerate(self.key)]

    def __call__(self, changes: DataFrame, batch: int) -> None:
        if self.version is not None and batch <= self.version:
            return
        row = [c for c in changes.columns if c not in ("_sign", "_seq")]
        order = F.struct(*[c for c in ("_seq", "_sign") if c in changes.columns])
        last = changes.groupBy(*self.key).agg(F.max_by(F.struct(*row), order).alias("_r"), F.max_by("_sign", order).alias("_s"), F.min_by("_sign", order).alias("_first"))
        now = self.table()
        if now is not None:
            there = now.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)], F.lit(True).alias("_there"))
            last = last.join(there, self._met(last, there), "left").drop(*[f"_k{i}" for i in range(len(self.key))])
        else:
            last = last.withColumn("_there", F.lit(None).cast("boolean"))
        is_there = F.coalesce("_there", F.lit(False))
        insert, delete = (F.col("_s") > 0) & (F.col("_first") > 0), F.col("_s") < 0
        update = (F.col("_s") > 0) & (F.col("_first") < 0)
        clash = (insert & is_there & F.lit(self.policy["insert"] == "panic")) | (update & ~is_there & F.lit(self.policy["update"] == "panic")) | (delete & ~is_there & F.lit(self.policy["delete"] == "panic"))
        last = last.where(F.when(clash, F.raise_error(F.lit("conflict with the table")).cast("boolean")).otherwise(F.lit(True)))
        skip = (insert & is_there & F.lit(self.policy["insert"] == "nothing")) | (update & ~is_there & F.lit(self.policy["update"] == "nothing"))
        last = last.where(~skip)
        new = last.where("_s > 0").select("_r.*")
        if now is not None:
            gone = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)])
            new = now.join(gone, self._met(now, gone), "left_anti").select(*row).unionByName(new.select(*row))
        new.write.mode("overwrite").parquet(f"{self.path}/v{batch}")
        self.version = batch
        path, fs = self._folder()
        for old in sorted(self._versions())[:-2]:  # readers of the one before may still be at work
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}"), True)
