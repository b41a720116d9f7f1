"""Tables from files: CSV, Parquet and Delta, from any store that Spark reads, with or without marker files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sluice.errors import ConfigError


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The files right below folder, by Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(s.getPath().toString() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if s.isFile())


def marked(files: list[str], extension: str, marker: str) -> list[str]:
    """Files whose marker (the same name with the marker's ending) is there too."""
    there = set(files)
    own = [f for f in files if f.endswith(extension)]
    return [f for f in own if f[: -len(extension)] + marker in there]


def read(spark: SparkSession, path: str, kind: str = "parquet", columns: list[str] | None = None, schema: T.StructType | None = None, extension: str | None = None, marker: str | None = None) -> DataFrame:
    """A batch table of all files in path. With `marker`, only of those whose marker file is there."""
    if kind not in ("csv", "parquet", "delta"):
        raise ConfigError(f"no file type {kind}")
    reader = spark.read.format(kind)
    if schema:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", "true").option("inferSchema", str(schema is None).lower())
    paths = marked(listed(spark, path), extension or f".{kind}", marker) if marker else [path]
    if marker and not paths:
        return spark.createDataFrame([], schema or T.StructType())
    if extension and not marker and kind != "delta":
        reader = reader.option("pathGlobFilter", f"*{extension}")
    df = reader.load(paths if kind != "delta" else paths[0])
    return df.select(*columns) if columns else df


def stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", columns: list[str] | None = None, extension: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """A stream of the rows of new files in path; each file is read once."""
    reader = spark.readStream.format(kind).schema(schema)
    if kind == "csv":
        reader = reader.option("header", "true")
    if extension:
        reader = reader.option("pathGlobFilter", f"*{extension}")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    df = reader.load(path)
    return df.select(*columns) if columns else df


class Marked:
    """Data files as their markers appear: poll() gives the rows of those not given before, as a batch.

    Spark's file streams skip empty files, and markers are empty; so the folder is listed on the driver (names alone),
    and the names given so far are kept under `state`, written before the next poll can see them.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, kind: str, extension: str, marker: str, state: str):
        self.spark, self.path, self.schema, self.kind, self.extension, self.marker, self.state = spark, path, schema, kind, extension, marker, state

    def given(self) -> set[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.state)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return set()
        return {r["path"] for r in self.spark.read.parquet(self.state).collect()}

    def poll(self) -> DataFrame | None:
        """The rows of new files; None where there is none. Call done() with the same files' rows written."""
        self.now = [f for f in marked(listed(self.spark, self.path), self.extension, self.marker) if f not in self.given()]
        if not self.now:
            return None
        reader = self.spark.read.format(self.kind).schema(self.schema)
        if self.kind == "csv":
            reader = reader.option("header", "true")
        return reader.load(self.now)

    def done(self) -> None:
        if self.now:
            self.spark.createDataFrame([(f,) for f in self.now], "path string").coalesce(1).write.mode("append").parquet(self.state)
